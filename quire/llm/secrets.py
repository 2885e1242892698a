"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame expressions alone.

A candidate is a long run of key characters with digits or both cases in it, what is assigned to a name
like ``token``, or the password of a URL. The forest looks at its length, its character classes and their transitions, how much of it
dictionary words cover, the path of its document and the words around it. It is trained by Spark's own
library on labelled findings, a bounded table, and then written out as one column expression: the share
of trees that vote for a secret. So scanning, scoring and redaction happen inside the row of a document,
without a shuffle, over whole texts.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = r"[A-Za-z0-9+/_\-]"
_NAMES = "token|secret|passwd|password|pwd|apikey|api_key|api-key|credential"
#: A telling name with its ending, as in ``client_secret_value`` or ``accessKeyId``, and its closing quote.
_NAMED = rf"(?:(?i:{_NAMES})|(?<![A-Za-z])(?i:key|auth|bearer)|Key|Auth)(?:(?i:[_\-.][a-z0-9_\-.]{{0,30}})|[A-Z][A-Za-z0-9]{{0,30}}|[sS]?[0-9]{{0,3}})[\"']?\]?"
_ASSIGNS = r"(?:=>|:=|[=:])"
_URL = r"://[^\s/:@\"']{0,128}:"
#: What is looked at: the password of a URL, a run of key characters with a digit or both cases, or a value
#: assigned to a telling name. A look-behind must be bounded, so up to 100 blanks may align a value.
CANDIDATE = (
    rf"(?<=:)(?=[^\s/@\"']{{1,256}}@)(?<={_URL})[^\s/@\"']+"
    rf"|(?<!{_KEY})(?={_KEY}{{16}})(?={_KEY}*?(?:[0-9]|[a-z][A-Z]|[A-Z]{{2}}[a-z])){_KEY}{{16,}}={{0,2}}"
    rf"|(?<=[=:>\s\"'])(?<=[=:>]\s{{0,8}}[\"']?)(?<={_NAMED}\s{{0,100}}{_ASSIGNS}\s{{0,8}}[\"']?)(?![=:>]|[A-Za-z0-9+.\-]{{1,20}}://[^\s/@]{{1,200}}@)[^\s\"']{{8,}}"
)
#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 40
#: Words of a plain dictionary; placeholders and identifiers are made of such.
DICTIONARY = [
    "access", "account", "admin", "auth", "build", "change", "class", "client", "code", "config", "data", "default", "demo",
    "dummy", "example", "file", "foobar", "goes", "group", "handle", "here", "image", "index", "insert", "internal", "java",
    "lorem", "main", "name", "none", "null", "page", "password", "placeholder", "public", "replace", "request", "sample",
    "secret", "server", "service", "source", "string", "test", "this", "token", "update", "user", "value", "version", "your",
]
THRESHOLD = 0.5
MARK = "[SECRET]"
TREES, DEPTH = 24, 6


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.length(candidate), F.lit(1))

    def count(text: Column, pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")

    def near(text: Column, pattern: str) -> Column:
        return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False)).cast("double")

    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    return {
        "length": F.length(candidate).cast("double"),
        "digits": count(candidate, "[0-9]") / size,
        "upper": count(candidate, "[A-Z]") / size,
        "marks": count(candidate, "[A-Za-z0-9]") / size,
        "hex": count(candidate, "[0-9a-fA-F]") / size,
        "turns": F.size(F.split(candidate, turns)).cast("double") / size,
        "kinds": F.size(F.array_distinct(F.split(candidate, ""))).cast("double"),
        "vowels": count(candidate, "[aeiou]") / size,
        "words": count(F.lower(candidate), "|".join(DICTIONARY)) / size,
        "named": near(before, rf"(?:{_NAMED}\s*{_ASSIGNS}?|(?i:{_NAMES}|key|auth|bearer))\s*[\"']?$"),
        "url": near(before, rf"{_URL}$") * near(after, "^@"),
        "assigned": near(before, r"[=:>]\s{0,8}[\"']?$"),
        "quoted": near(before, "[\"']$") * near(after, "^[\"']"),
        "digest": near(before, r"(?i)(sha|md5|commit|hash|checksum|digest|revision|uuid|integrity|base64)\W{0,4}\w{0,6}\W{0,4}$"),
        "number": near(before, r"(?i)(card|phone|order|account|invoice|isbn|id)\W{0,4}$"),
        "sample_path": near(path, r"(?i)(test|example|sample|docs?/|fixture|spec|mock)"),
        "config_path": near(path, r"(?i)(\.env|conf|secret|deploy|prod|\.ya?ml|\.ini)"),
    }


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Findings ``(id, candidate, before, after, path, label)`` made by rule: half are secrets.

    The digits and letters come from hashes of the row number. Secrets are tokens, keys and
    passwords as services issue them, most of them assigned to a telling name; the others are what
    scanners report wrongly: digests, commits, identifiers, numbers, placeholders, plain names.
    """
    n = F.col("id")

    def hashed(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), n.cast("string")), 256)

    def pick(salt: str, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(salt), n), F.lit(len(options))) + 1).cast("int"))

    code = F.regexp_replace(F.base64(F.unhex(hashed("b"))), "=", "")
    digits = F.translate(hashed("d"), "abcdef", "012345")
    word = pick("w", DICTIONARY)
    other = pick("v", DICTIONARY)
    letters = F.translate(code, "0123456789+/", "GhIjKlMnOpQr")
    lower = F.translate(hashed("f"), "0123456789", "ghiklmnprt")
    syllables = ["in", "ter", "na", "tion", "al", "ver", "si", "ble", "pro", "con", "men", "ta", "ry", "ex", "o", "de"]
    spoken = F.concat(*[pick(f"s{i}", syllables) for i in range(5)])
    good = [
        (F.substring(hashed("a"), 1, 40), pick("n1", ["token = \"", "token: \"", "secret=\"", "api_key = \"", "auth token \"", "TOKEN = \""])),
        (F.upper(F.substring(hashed("a"), 1, 40)), pick("n2", ["TOKEN = \"", "SECRET: \"", "API_KEY=\""])),
        (F.substring(code, 1, 32), pick("n3", ["api_key: ", "secret = \"", "password = \"", "Bearer ", "key=\""])),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(hashed("k"), "01", "xy"), 1, 16))), pick("n4", ["aws ", "id = \"", "key: ", " "])),
        (F.concat(F.lit("ghp_"), F.substring(F.translate(code, "+/", "ab"), 1, 36)), pick("n5", ["", "url ", "token=", "header "])),
        (F.concat(F.substring(code, 1, 7), F.lit("!"), F.substring(digits, 1, 3)), pick("n6", ["password=", "passwd: \"", "pwd = \""])),
        (F.substring(letters, 1, 32), pick("n7", ["secret_key = \"", "client_secret_value = ", "key = \"", "auth: \"", "Bearer ", "\"apiKey\": \""])),
        (F.concat(F.substring(lower, 1, 6), pick("n8", ["!", "-", "", "#"]), F.substring(lower, 7, 5)), pick("n9", ["\"password\": \"", "db_password      = ", "'passwd': '", "secret: \"", "password="])),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(lower, 1, 16))), pick("na", ["aws_access_key_id = ", "\"AccessKeyId\": \"", "key: "])),
        (F.concat(F.substring(lower, 1, 5), pick("nb", ["", "!", "_"]), F.substring(code, 1, 6)), pick("nc", ["postgres://admin:", "https://deploy:", "amqp://app_user:"])),
    ]
    bad = [
        (F.substring(hashed("a"), 1, 40), pick("m1", ["commit ", "revision: ", "sha1 = ", "hash \"", "merge commit "])),
        (hashed("a"), pick("m2", ["sha256:", "checksum = \"", "integrity sha256-", "digest: "])),
        (F.substring(digits, 1, 16), pick("m3", ["card ", "order ", "of ", "the ", "phone ", "und ", "los "])),
        (F.concat(F.initcap(word), F.initcap(other), F.lit("Version"), F.substring(digits, 1, 1), F.lit("Internal")), pick("m4", ["class ", "new ", "call "])),
        (F.concat(F.lit("your-"), word, F.lit("-"), other, F.lit("-here1")), pick("m5", ["token = \"", "api_key: ", "password=\"", "secret = "])),
        (F.concat(F.lit("src/main/"), word, F.lit("/v"), F.substring(digits, 1, 1), F.lit("/"), other), pick("m6", ["file ", "in ", "path: "])),
        (F.concat(F.substring(digits, 1, 4), F.lit("-01-"), F.substring(digits, 5, 2), F.lit("-"), word, F.lit("-"), other), pick("m7", ["release ", "tag = ", "on "])),
        (F.concat_ws("-", F.substring(hashed("u"), 1, 8), F.substring(hashed("u"), 9, 4), F.substring(hashed("u"), 13, 4), F.substring(hashed("u"), 17, 4), F.substring(hashed("u"), 21, 12)), pick("m8", ["uuid ", "id: ", "run "])),
        (F.concat(word, other, word), pick("m9", ["password: ", "token = ", "secret=\""])),
        (F.concat(F.initcap(word), F.initcap(other), F.initcap(pick("x", DICTIONARY))), pick("ma", ["class ", "new ", "key: ", "the "])),
        (F.concat(pick("y", ["self.", "get_", "${", "os.environ."]), word, F.lit("_"), other), pick("mb", ["key = ", "auth: ", "\"token\": \"", "password = "])),
        (spoken, pick("md", ["key: ", "auth: ", "key = ", "secret: ", "password: "])),
        (F.concat(word, pick("z", ["", "-", "_"]), other), pick("mc", ["https://user:", "postgres://admin:", "amqp://user:"])),
    ]

    def choose(kinds: list, part: int, number: Column) -> Column:
        result = kinds[-1][part]
        for i, kind in reversed(list(enumerate(kinds[:-1]))):
            result = F.when(number == i, kind[part]).otherwise(result)
        return result

    secret = n % 2 == 0
    kind = F.floor(n / 2)
    lead = pick("l", ["", "the ", "se los ", "und ", "de la ", "set ", "\n", "// "])
    before = F.concat(lead, F.when(secret, choose(good, 1, kind % len(good))).otherwise(choose(bad, 1, kind % len(bad))))
    return spark.range(0, rows, 1, 1).select(
        "id",
        F.when(secret, choose(good, 0, kind % len(good))).otherwise(choose(bad, 0, kind % len(bad))).alias("candidate"),
        before.alias("before"),
        F.when(F.rlike(before, F.lit(rf"{_URL}$")), F.lit("@host/db"))
        .when(before.endswith('"'), F.lit('" ')).otherwise(pick("t", [" ", "\n", ". ", " and "])).alias("after"),
        F.when(secret, pick("p", ["src0", "src7", "conf/app.yaml", ".env", "deploy/prod.ini", "lib/a.py"]))
        .otherwise(pick("q", ["src0", "src7", "tests/a.py", "docs/example.md", "lib/a.py", "conf/app.yaml"]))
        .alias("path"),
        secret.cast("double").alias("label"),
    )


def train(findings: DataFrame) -> list[str]:
    """The trees of a forest fitted on ``findings(candidate, before, after, path, label)``, as text.

    The table is labelled by hand or by rule and small; it is brought to one partition, so that the
    forest does not depend on how it was stored.
    """
    columns = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = findings.filter("label IS NOT NULL").select(F.col("label").cast("double").alias("label"), *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in columns.items()])
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows.coalesce(1)).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, maxBins=64).fit(ready)
    return [t.toDebugString for t in forest.trees]


def votes(trees: list[str], columns: dict[str, Column]) -> Column:
    """Share of the trees that vote for label 1."""
    names = list(columns)

    def grow(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        test = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = grow(lines)
        lines.pop(0)  # Else
        no = grow(lines)
        return F.when(columns[names[int(test[1])]] <= float(test[2]), yes).otherwise(no)

    total = F.lit(0.0)
    for tree in trees:
        total = total + grow([x for x in tree.splitlines() if "If (" in x or "Else (" in x or "Predict:" in x])
    return total / len(trees)


def findings(docs: DataFrame, trees: list[str], text_col: str = "text", path_col: str = "source", out: str = "findings") -> DataFrame:
    """``docs`` with ``out``: the candidates of each text in order, and the texts between them in ``<out>_rest``.

    A candidate has ``candidate``, ``score`` (0 to 1) and ``is_secret``. Null texts have none; a null
    path is an unknown one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = f"{out}_rest"
    cut = docs.withColumn(out, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    cut = cut.withColumn(rest, F.when(F.size(out) > 0, F.split(text, CANDIDATE, -1)))
    names = list(features(*[F.lit("")] * 4))

    def described(c: Column, i: Column) -> Column:
        far = F.regexp_replace(F.right(F.get(F.col(rest), i), F.lit(4 * NEAR)), r"\s{9,}", " ")  # aligned values
        before, after = F.right(far, F.lit(NEAR)), F.left(F.get(F.col(rest), i + 1), F.lit(NEAR))
        own = features(c, before, after, F.col(path_col))
        return F.struct(c.alias("candidate"), *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in own.items()])

    def scored(x: Column) -> Column:
        return F.struct(x["candidate"].alias("candidate"), votes(trees, {k: x[k] for k in names}).alias("score"))

    cut = cut.withColumn(out, F.transform(F.transform(out, described), scored))
    return cut.withColumn(out, F.transform(out, lambda x: F.struct(x["candidate"], x["score"], (x["score"] >= THRESHOLD).alias("is_secret"))))


def scan(docs: DataFrame, trees: list[str]) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, nth, length, candidate_sha256, score, is_secret)``.

    One row per candidate; ``nth`` is its number in the text, from 1.
    """
    rows = findings(docs.select("doc_id", "text", "source"), trees).select("doc_id", F.posexplode("findings").alias("at", "x"))
    return rows.select(
        "doc_id",
        (F.col("at") + 1).alias("nth"),
        F.length("x.candidate").alias("length"),
        F.sha2(F.col("x.candidate").cast("binary"), 256).alias("candidate_sha256"),
        "x.score",
        "x.is_secret",
    )


def redacted(docs: DataFrame, trees: list[str], text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``MARK``; rows without one are as they were.

    A column ``n_chars``, if there is one, follows the text where it changes.
    """
    marked = findings(docs, trees, text_col, path_col, "__findings")
    piece = F.zip_with(
        "__findings_rest",
        "__findings",
        lambda rest, x: F.concat(rest, F.coalesce(F.when(x["is_secret"], F.lit(MARK)).otherwise(x["candidate"]), F.lit(""))),
    )
    hit = F.exists("__findings", lambda x: x["is_secret"])
    marked = marked.withColumn("__text", F.when(hit, F.array_join(piece, "")))
    new = {text_col: F.coalesce("__text", text_col)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("__text").cast(docs.schema["n_chars"].dataType), "n_chars")
    return marked.withColumns(new).select(*docs.columns)
