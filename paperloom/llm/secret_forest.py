"""Operator 10: secret scanning with a random forest that removes false positives.

Candidates are runs of token characters with a digit, values that follow a key
such as ``password=``, passwords in connection strings, and private keys in PEM
blocks. Each is described by its length, character
classes and transitions, the share that dictionary words cover, the path of
its document and its neighbouring words. A random forest, trained from
labelled findings, scores it. Trees are compiled to SQL expressions over the
candidates of a row, so scanning is one pass of SQL functions without any
shuffle, explode or Python.

Null text has no findings and stays null. Every match is a finding with its own
place and score. A value is a secret if it is one in any of its places, and is then
redacted everywhere. Empty tables give empty results. ``path`` may be null or missing.
"""

from __future__ import annotations

import json
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import fresh

#: Labelled findings that the built-in model is trained on.
FINDINGS = 4000
#: Tokens: a run of 12 or more token characters with a digit in it.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{12})[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
#: Values: what follows a key and : or =.
VALUE = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credential)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[^\s\"'<>]{6,}"
VALUE_GROUP = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credential)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>]{6,})"
#: Passwords between the user's name and the host of a connection string.
CREDENTIAL = r"(?<=://)[^\s:/@]{1,64}:[^\s/@\"'<>]{6,128}(?=@)"
CREDENTIAL_GROUP = r"(?<=://)[^\s:/@]{1,64}:([^\s/@\"'<>]{6,128})(?=@)"
#: Private keys with their armour.
PEM = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.()-]*?-----END [A-Z ]{0,24}PRIVATE KEY-----"
#: Base64 that ends with its padding.
PADDED = r"^(?:[A-Za-z0-9+/_-]{4})+(?:[A-Za-z0-9+/_-]{2}==|[A-Za-z0-9+/_-]{3}=)$"
NEAR = 40
#: Words of the coverage dictionary, of placeholders, keys and digests.
WORDS = "about access account address after again also always and another api are article author back base been before best between body book build button call can change check city class client code color comment common config content core could country create data date day default demo design detail different dev document down each edit email end error event example file find first for form free from function game general get getting good great group guide have header health help here high home house how html http https image index info item java key large last level life like line link list local log long made mail main make many map media member menu message model more most name need new news next not note number office old one only open order other out over page part people photo place plan play point post price product profile program project public question read real report research result review right room safe sale sample school science search section server service set should show simple site size small some sport start state stock store story style system table tag team test text that the their them then there these they thing this time title today tool top topic travel two type update user using value version video view want was water web week well were what when where which who will with word work world would year you your".split()
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|your|changeme|xxxx|0000|1234567|test|fake|redacted|lorem|\$\{|\{\{|%\(|environ|getenv|process\.env"
KEYS = r"(?i)passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private"
DIGESTS = r"(?i)sha-?\d*|md5|commit|checksum|digest|uuid|guid|isbn|doi|etag|build|revision|session|order|invoice|phone"
PREFIXES = r"^(AKIA|ASIA|gh[pousr]_|xox[abp]-|sk[-_](live|test)?|AIza|eyJ|glpat-|npm_)"
FEATURES = ["length", "digits", "uppers", "distinct", "transitions", "covered", "vowels", "slashes", "hex", "uuid", "prefix", "assigned", "key_near", "digest_near", "placeholder", "test_path", "url_near", "pem", "credential", "padded", "lower_only"]

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate, as doubles."""
    n = F.greatest(F.length(value), F.lit(1))
    classes = F.translate(value, _UPPER + _LOWER + _DIGIT, "U" * 26 + "l" * 26 + "0" * 10)
    left = F.regexp_replace(F.lower(value), "|".join(sorted((w for w in WORDS if len(w) > 2), key=lambda w: (-len(w), w))), "")
    near = F.concat_ws(" ", before, after)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    found = [
        n, F.length(F.regexp_replace(value, "[^0-9]", "")) / n, F.length(F.regexp_replace(value, "[^A-Z]", "")) / n, F.size(F.array_distinct(F.split(value, ""))) / n,
        F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) / n, 1 - F.length(left) / n, F.length(F.regexp_replace(value, "[^aeiouAEIOU]", "")) / n, F.length(F.regexp_replace(value, "[^/_-]", "")) / n,
        flag(value.rlike(r"^[0-9a-fA-F]+$")), flag(value.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")), flag(value.rlike(PREFIXES)), flag(before.rlike(r"[:=]\s*[\"']?$")),
        flag(before.rlike(KEYS)), flag(before.rlike(DIGESTS)), flag(value.rlike(PLACEHOLDER) | near.rlike(PLACEHOLDER)), flag(F.coalesce(path, F.lit("")).rlike(r"(?i)test|example|fixture|mock|docs?/|sample")), flag(before.rlike(r"(?i)(https?:|www\.|/)\S*$")),
        flag(value.startswith("-----BEGIN")), flag(before.rlike(r"://[^\s:/@]+:$")), flag(value.rlike(PADDED)), flag(value.rlike(r"^[a-z]+$")),
    ]
    return [c.cast("double") for c in found]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, float]]:
    """(value, before, after, path, label): findings of common kinds, true secrets and false alarms in about equal parts, made by a seeded generator."""
    r = random.Random(seed)
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, alnum = "0123456789abcdef", _UPPER + _LOWER + _DIGIT
    word = lambda: r.choice(WORDS) if r.random() < 0.5 else "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    key = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "credential"]) + r.choice(["=", " = ", ": ", '="', ' = "', '": "', "='"])
    rows = []
    for i in range(n):
        before, after, path = words(r.randint(0, 6)) + " ", " " + words(r.randint(0, 3)), r.choice(["src/main.py", "app/config.yml", "web", "notes.md", "src7", "deploy/env"])
        if i % 2:
            kind = r.randint(0, 13)
            value = [
                lambda: "AKIA" + some(_UPPER + "234567", 16), lambda: some(hexes, r.choice([18, 20, 32, 40, 64])), lambda: some(alnum + "+/", 40), lambda: r.choice(["ghp_", "gho_"]) + some(alnum, 36),
                lambda: "sk-" + some(alnum, r.randint(24, 48)), lambda: some(alnum, r.randint(16, 40)), lambda: some(alnum + "_-", r.randint(20, 44)), lambda: "eyJ" + some(alnum, r.randint(30, 60)), lambda: some(alnum + "!@#%", r.randint(9, 16)),
                lambda: "".join(r.choice(WORDS) for _ in range(r.randint(4, 6))), lambda: some(_LOWER, r.randint(14, 24)), lambda: r.choice(WORDS) + some(_DIGIT, r.randint(1, 4)) + r.choice(["!", "pass", "#", ""]) + some(alnum, 3), lambda: some(alnum + "+/", 4 * r.randint(5, 12) - 2) + "==",
                lambda: (lambda kind: f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(some(alnum + "+/", 64) for _ in range(r.randint(1, 6))) + f"\n-----END {kind}PRIVATE KEY-----")(r.choice(["", "RSA ", "EC ", "OPENSSH "])),
            ][kind]()
            if kind == 11 and r.random() < 0.5:
                before, after = before + r.choice(["postgres", "mysql", "amqp", "https", "redis"]) + "://" + r.choice(["admin", "root", word()]) + ":", "@" + word() + after
            elif kind != 13 and (kind not in (0, 3, 4, 7) or r.random() < 0.4):
                before += key()
            rows.append((value, before[-NEAR:], after[:NEAR], path, 1.0))
            continue
        kind = r.randint(0, 12)
        value = [
            lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: some(hexes, r.choice([32, 40, 64])), lambda: "-".join(word() for _ in range(r.randint(2, 5))) + "-" + some(_DIGIT, r.randint(1, 4)), lambda: some(_DIGIT, r.randint(12, 18)),
            lambda: r.choice(["your_api_key_", "EXAMPLE_KEY_", "changeme", "xxxxxxxxxxxx", "dummy-token-", "test_password_"]) + some(_DIGIT, r.randint(1, 4)), lambda: r.choice("xX0*a") * r.randint(12, 24) + "1", lambda: "/".join(word() for _ in range(3)) + "/" + some(_DIGIT, r.randint(3, 6)),
            lambda: "".join(word().title() for _ in range(3)) + some(_DIGIT, r.randint(1, 3)), lambda: word() + "_" + word() + "_v" + some(_DIGIT, 2), lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
            lambda: (word() + word() + word())[: r.randint(6, 12)].ljust(6, "e"), lambda: r.choice(["${", "{{", "%("]) + word().upper() + r.choice(["_KEY", "_TOKEN", ""]) + r.choice(["}", "}}", ")s"]), lambda: r.choice(["os.environ", "process.env.", "getenv("]) + word().upper(),
        ][kind]()
        if kind == 1:
            before += r.choice(["commit ", "sha256:", "md5: ", "checksum=", "digest: ", "revision "])
        elif kind >= 10 or kind == 4 and r.random() < 0.7:
            before += key()
        elif kind == 6:
            before += r.choice(["https://www.", "http://", "/"])
        elif r.random() < 0.3:
            before += r.choice(["id=", "uuid: ", "order ", "build ", "page=", "session "])
        if r.random() < 0.1:
            path = r.choice(["tests/test_login.py", "docs/example.md"])
        rows.append((value, before[-NEAR:], after[:NEAR], path, 0.0))
    return rows


def _expression(node, f: list[Column]) -> Column:
    """A fitted tree as nested conditions that give the share of secrets in the leaf."""
    if "LeafNode" in node.getClass().getSimpleName():
        counts = [node.impurityStats().stats()[k] for k in range(2)]
        return F.lit(float(counts[1] / max(1e-9, counts[0] + counts[1])))
    split = node.split()
    return F.when(f[split.featureIndex()] <= float(split.threshold()), _expression(node.leftChild(), f)).otherwise(_expression(node.rightChild(), f))


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = 12, depth: int = 6, seed: int = 3):
    """A random forest from (value, before, after, path, label); the built-in findings by default."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    if findings is None:
        rows = json.dumps([dict(zip(("value", "before", "after", "path", "label"), row, strict=True)) for row in labelled_findings()])
        findings = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(rows), "array<struct<value: string, before: string, after: string, path: string, label: double>>")))
    x = F.array(*features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))
    rows = findings.select(array_to_vector(x).alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="sqrt").fit(rows)


def forest_score(model, f: list[Column]) -> Column:
    """The mean over the forest's trees, as one SQL expression."""
    roots = [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode() for t in model.trees]
    return reduce(lambda a, b: a + b, [_expression(r, f) for r in roots]) / len(roots)


def _sums(n: Column) -> Column:
    """For an array of ints: the sum of all before each one. In runs of 256, so that a long array isn't copied for each element."""
    zero = F.array().cast("array<int>")
    ends = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("sum"), zero.alias("before")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")))
    starts = F.when(F.size(n) > 0, F.sequence(F.lit(1), F.size(n), F.lit(256))).otherwise(zero)
    runs = F.transform(starts, lambda k: ends(F.slice(n, k, 256)))
    joined = F.aggregate(runs, F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("before")), lambda s, r: F.struct((s["sum"] + r["sum"]).alias("sum"), F.concat(s["before"], F.array(F.transform(r["before"], lambda x: x + s["sum"]))).alias("before")))
    return F.flatten(joined["before"])


def _places(df: DataFrame, t: Column, pattern: str, group: str | None, name: str) -> DataFrame:
    """Add ``name``: (value, at) of each match, or of what the first group of ``group``, the same pattern, holds at its end; ``at`` counts from 1.

    The text split by the pattern and the matches take turns, so their lengths give the places.
    """
    none = F.array().cast("array<string>")
    hit = t.rlike(pattern)
    mine = fresh(df.columns)
    gaps, every, part, begin = (mine + x for x in ("gaps", "whole", "part", "from"))
    found = df.withColumns({gaps: F.when(hit, F.split(t, pattern, -1)).otherwise(none), every: F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)})
    found = found.withColumn(part, F.when(hit, F.regexp_extract_all(t, F.lit(group), F.lit(1))).otherwise(none) if group else F.col(every))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(every)), every, lambda g, w: F.length(g) + F.length(w))
    found = found.withColumn(begin, _sums(steps))
    first = F.zip_with(begin, F.arrays_zip(gaps, every, part), lambda f, z: F.struct(z[part].alias("value"), (f + F.length(z[gaps]) + F.length(z[every]) - F.length(z[part]) + 1).alias("at")))
    return found.withColumn(name, F.filter(first, lambda m: m["value"].isNotNull() & m["at"].isNotNull())).drop(gaps, every, part, begin)


def find_secrets(df: DataFrame, model=None, text: str = "text", path: str | None = None, threshold: float = 0.5, name: str = "findings") -> DataFrame:
    """Add ``findings``: array of (value, at, score, secret), one for each place of a candidate in a text; ``at`` is the place, from 1.

    ``score`` is the place's own; ``secret`` holds if any place of the value reaches ``threshold``.
    """
    model = model or train(df.sparkSession)
    t = F.col(text).cast("string")
    mine = fresh(df.columns)
    values, tokens, credentials, keys, at_, seen_, x_, scores_, secret_ = (mine + x for x in ("values", "tokens", "credentials", "keys", "at", "seen", "x", "scores", "secret"))
    rows = df
    for pattern, group, column in ((VALUE, VALUE_GROUP, values), (TOKEN, None, tokens), (CREDENTIAL, CREDENTIAL_GROUP, credentials), (PEM, None, keys)):
        rows = _places(rows, t, pattern, group, column)

    def strip(m: Column) -> Column:
        rest = F.regexp_replace(m["value"], r"^[^=]{0,24}=(?=[^=])", "")
        bare = F.regexp_replace(rest, r"[.,;)]+$", "")
        value = F.when(bare.rlike(PADDED), bare).otherwise(F.regexp_replace(bare, r"[=.,;)]+$", ""))
        return F.struct(value.alias("value"), (m["at"] + F.length(m["value"]) - F.length(rest)).alias("at"))

    stripped = F.filter(F.transform(F.concat(values, tokens), strip), lambda m: F.length(m["value"]) >= 6)
    located = rows.withColumn(at_, F.array_distinct(F.concat(stripped, credentials, keys))).drop(values, tokens, credentials, keys)

    source = F.col(path) if path else F.lit("")

    def seen(c: Column) -> Column:
        at = c["at"]
        start = F.greatest(at - NEAR, F.lit(1))
        return F.struct(c["value"].alias("value"), at.alias("at"), F.substr(t, start, at - start).alias("before"), F.substr(t, at + F.length(c["value"]), F.lit(NEAR)).alias("after"))

    described = located.withColumn(seen_, F.transform(at_, seen)).withColumn(x_, F.transform(seen_, lambda c: F.array(*features(c["value"], c["before"], c["after"], source))))
    scores = F.transform(x_, lambda x: forest_score(model, [F.get(x, F.lit(k)) for k in range(len(FEATURES))]))
    scored = described.withColumn(scores_, scores)
    secret = F.array_distinct(F.transform(F.filter(F.arrays_zip(at_, scores_), lambda z: z[scores_] >= threshold), lambda z: z[at_]["value"]))
    result = F.transform(F.arrays_zip(at_, scores_), lambda z: F.struct(z[at_]["value"].alias("value"), z[at_]["at"].alias("at"), z[scores_].alias("score"), F.array_contains(secret_, z[at_]["value"]).alias("secret")))
    return scored.withColumn(secret_, secret).withColumn(name, result).drop(at_, seen_, x_, scores_, secret_)


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every secret replaced, longest first."""
    values = F.array_distinct(F.transform(F.filter(findings, lambda f: f["secret"]), lambda f: f["value"]))
    secrets = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(secrets) > 0, F.aggregate(secrets, text, lambda t, v: F.replace(t, v, F.lit(mark)))).otherwise(text)
