"""Text functions as native expressions (U2), no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The basic English stop words.
STOP_WORDS = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once".split()


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: str | Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def text_or_empty(c: str | Column) -> Column:
    """Null as an empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def field(c: str | Column, kind: str) -> Column:
    """One field of a free-text metadata blob: paper, title, authors or abstract; null if absent."""
    pattern = {
        "paper": r"Paper:\s*(\S+)",
        "title": r"(?s)Title:\s*(.+?)(?=\nAuthors?:|\z)",
        "authors": r"(?s)Authors?:\s*(.+?)(?=\nComments?:|Abstract:|\z)",
        "abstract": r"(?s)Abstract:\s*(.+?)(?=\\\\|\z)",
    }[kind]
    return F.nullif(squeeze(F.regexp_extract(col(c), pattern, 1)), F.lit(""))


def clean_latex(c: str | Column) -> Column:
    """LaTeX commands, formulas and markup characters out of a title."""
    out = col(c)
    for pattern in (r"\\[a-zA-Z]+\{.*?\}", r"\\[a-zA-Z]+", r"\$.*?\$", r"[{}$\\]"):
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def remove_stop_words(c: str | Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens without stop words; punctuation is kept and glued to the word before it."""
    spaced = F.regexp_replace(F.lower(text_or_empty(c)), r"([.,;:!?])", " $1 ")
    tokens = F.filter(F.split(squeeze(spaced), " "), lambda t: (t != "") & ~t.isin(stop_words))
    return F.trim(F.regexp_replace(F.array_join(tokens, " "), r"\s+([.,;:!?])", "$1"))


def combine_fields(title, abstract, authors, mode: str = "title") -> Column:
    """One text of several fields; an unknown mode is an error."""
    t, b, a = (text_or_empty(x) for x in (title, abstract, authors))
    if mode in ("title", "abstract", "authors"):
        return {"title": t, "abstract": b, "authors": a}[mode]
    more = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
    if mode == "title_abstract":
        return F.concat(t, more(" ", b))
    if mode == "combined":
        return F.concat(t, more(" [ABSTRACT] ", b), more(" [AUTHORS] ", a))
    raise ValueError(f"unknown mode {mode!r}")


def title_sep_abstract(title, abstract) -> Column:
    """``title [SEP] abstract``, or the one that is there."""
    t, b = text_or_empty(title), text_or_empty(abstract)
    return F.when((t != "") & (b != ""), F.concat(t, F.lit(" [SEP] "), b)).otherwise(F.concat(t, b))


def tokenize_alpha(c: str | Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens of letters only, without stop words, in order and with repeats."""
    return F.filter(F.split(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(stop_words))


def word_set(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(clean_latex(c)), r"\s+"), lambda t: t != ""))


def word_overlap(a: str | Column, b: str | Column) -> Column:
    """The share of a's words that b has; 0 if a has none."""
    x = word_set(a)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, word_set(b))) / F.size(x)).otherwise(0.0)


def lookup(mapping: dict, key: str | Column, default: Column) -> Column:
    """A small constant mapping as an expression, with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), default) if pairs else default


def file_stem(name: str) -> str:
    """A name that is safe in a path."""
    return name.split("/")[-1].lower().replace("-", "_").replace(" ", "_")


def model_kind(name: str) -> str:
    """The family of a model by its name."""
    low = name.lower()
    return next((k for k in ("llama", "qwen", "mistral", "specter", "bert") if k in low), "auto")


def stamp(pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """The time of the run as text."""
    return F.date_format(F.current_timestamp(), pattern)
