"""Secret scan with DataFrame functions only: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more key-like characters, however long, and the
values assigned to a name for secrets, however short. The forest sees length,
how surprising each character is after the one before it (by character classes
of letters, counted over the corpus's own words), distinct characters, the
share that common words of the corpus cover, parts of the path (here
``source``), and the words before and after the candidate with the signs
between. It learns from labelled findings ``(doc_id, no, label)``. Where none
are given, findings are labelled by what the value is, which no feature states:
a digest of 32, 40 or 64 hexadecimal digits or a key of a known issuer's form is
a secret; a number, a value without digits and a UUID are none; all other
candidates are left to the forest.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, table

MAX_TRAIN, TREES, DEPTH = 20_000, 20, 6
DICTIONARY_WORDS = 200
_BODY = "[A-Za-z0-9+/_-]"
_PAD = r"(?![A-Za-z0-9+/_=-]|[\"'][A-Za-z0-9+/_-])"  # after the '=' of a padding no value follows
#: A whole run of 16 or more key-like characters, of any length; possessive, so each run is read once.
RUN = rf"(?:{_BODY}{{16,}}+(?:={{1,2}}+{_PAD})?+|{_BODY}{{15}}={{1,2}}+{_PAD}|{_BODY}{{14}}=={_PAD})"
CANDIDATE = rf"(?<!{_BODY}){RUN}"
#: From the end of the last candidate to that of the next; \G keeps the rest of a text from being searched from each of its places.
STEP = rf"(?s)\G.*?{CANDIDATE}"
KEY_WORDS = r"(?i)(token|secret|passw|pwd|api_?-?key|auth|credential|private|bearer|access)"
#: Whatever is assigned to a name for secrets; the value stands in a lookahead, as it may hold a further name.
ASSIGNED = KEY_WORDS.replace("(token", "(?:token") + r"[^\s=:\"']{0,60}+[\"']?+[ \t]*+[=:][ \t]*+(?=(\"[^\"\r\n]++\"|'[^'\r\n]++'|[^\s\"',;]++))"
WORD_BEFORE = 40
#: Forms of issued keys.
ISSUED = r"\A(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{20,}.*)\z"
DIGEST = r"\A(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z"
UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
#: Parts of paths where keys are real, and where they are examples.
PATH_REAL, PATH_EXAMPLE = r"(?i)(env|conf|config|settings|deploy|secret|credential|prod)", r"(?i)(test|example|sample|mock|fixture|doc|demo|readme)"
AFTER = 40
FEATURES = ("length", "surprise", "uppers", "distinct", "covered", "key_word", "assigned", "quoted", "before_common", "after_common", "after_sign", "alone", "path_depth", "path_real", "path_example")


def candidates(docs: DataFrame) -> DataFrame:
    """Each candidate of each whole text with its number in the text and the words beside it.

    Runs of key-like characters are numbered in order; after them come the
    values, of any length and any characters, that are assigned to a name for
    secrets and are no such run as a whole.
    """
    # one array that binds the matches, so that each sees the end of the one before
    runs = F.transform(
        F.array(F.regexp_extract_all("text", F.lit(STEP), F.lit(0))),
        lambda ms: F.transform(ms, lambda m, i: F.struct(F.when(i > 0, F.right(F.get(ms, i - 1), F.lit(WORD_BEFORE + 2))).otherwise(F.lit("")).alias("last"), m.alias("match"), F.coalesce(F.substring(F.get(ms, i + 1), 1, AFTER), F.lit("")).alias("next"))),
    )[0]
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(1)), lambda v: ~F.rlike(v, F.lit(rf"\A[\"']?{RUN}[\"']?\z")))
    values = F.transform(values, lambda v: F.struct(F.lit(None).cast("string").alias("last"), v.alias("match"), F.lit("").alias("next")))
    # matches follow each other from the start of the text on, so what stands after the last one begins at the sum of their lengths
    docs = docs.select("doc_id", "source", "text", runs.alias("runs"), values.alias("values"))
    past = F.aggregate("runs", F.lit(0), lambda a, r: a + F.length(r["match"]))
    docs = docs.withColumn("tail", F.when(F.size("runs") > 0, F.substring(F.col("text"), past + 1, F.lit(AFTER))).otherwise(F.lit("")))
    found = docs.select("doc_id", "source", "tail", F.size("runs").alias("n"), F.posexplode(F.concat("runs", "values")).alias("no", "c"))
    found = found.select("doc_id", "source", "no", "c.last", "c.match", F.when(F.col("no") == F.col("n") - 1, F.col("tail")).otherwise(F.col("c.next")).alias("after"))
    run, quoted = F.col("last").isNotNull(), F.col("match").rlike("^[\"']")
    ends = lambda c, chars: F.regexp_extract(F.right(F.col(c), F.lit(1)), f"[{chars}]", 0)
    less = lambda c, n: F.substring(F.col(c), F.lit(1), F.length(c) - F.length(n))
    found = found.withColumn("candidate", F.when(run, F.regexp_extract("match", CANDIDATE, 0)).when(quoted, F.expr("substring(match, 2, length(match) - 2)")).otherwise(F.col("match")))
    found = found.withColumn("left", F.concat("last", less("match", "candidate"))).withColumn("quote", F.when(run, ends("left", "\"'")).when(quoted, F.substring("match", 1, 1)).otherwise(F.lit("")))
    found = found.withColumn("left", F.rtrim(less("left", "quote"), F.lit(" \t"))).withColumn("sign", F.when(run, ends("left", "=:")).otherwise(F.lit("=")))
    found = found.withColumn("left", F.rtrim(less("left", "sign"), F.lit(" \t")))
    # the name of an assignment may be quoted
    found = found.withColumn("left", F.when(F.col("sign") != "", less("left", ends("left", "\"'"))).otherwise(F.col("left")))
    word = F.regexp_extract(F.right("left", F.lit(WORD_BEFORE + 1)), rf"(?<![^\s=:\"'])[^\s=:\"']{{1,{WORD_BEFORE}}}+\z", 0)
    return found.select("doc_id", "source", "no", F.when(run, word).otherwise(F.lit("secret")).alias("before"), "after", "sign", "quote", "candidate").where("candidate <> ''")


def word_counts(docs: DataFrame) -> DataFrame:
    """``(w, n)``: the corpus's words of four to ten letters."""
    word = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}])[a-z]{4,10}(?![\p{L}\p{N}])"), 0)).alias("w"))
    return word.groupBy("w").agg(F.count("*").alias("n"))


def dictionary(counts: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words; ``words`` of them at most."""
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(words).collect()]


def transitions(counts: DataFrame) -> list[float]:
    """-ln P(class of a character | class of the one before) in words, one added to each count; 28 classes: a to z, digits, the rest."""
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1))
    pairs = counts.select("n", at.alias("i"), "w").groupBy(F.substring(F.col("w"), F.col("i"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n")).collect()  # 676 rows at most
    table = [[1.0] * 28 for _ in range(28)]
    for r in pairs:
        table[ord(r.pair[0]) - 97][ord(r.pair[1]) - 97] += r.n
    return [math.log(sum(row) / v) for row in table for v in row]


def _features(found: DataFrame, words: list[str], table: list[float]) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    code = lambda v: F.when(v.between("a", "z"), F.ascii(v) - 97).when(v.between("0", "9"), F.lit(26)).otherwise(F.lit(27))
    # arrays are columns of their own, as a lambda evaluates what it holds for each element
    found = found.withColumn("chars", F.split(c, "")).withColumn("codes", F.transform(F.split(F.lower(c), ""), code)).withColumn("table", F.array(*map(F.lit, table)))
    steps = F.zip_with(F.slice("codes", 1, F.greatest(F.size("codes") - 1, F.lit(0))), F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(0))), lambda a, b: a * 28 + b)
    found = found.withColumn("steps", steps)
    surprise = F.aggregate("steps", F.lit(0.0), lambda s, k: s + F.get("table", k)) / F.greatest(n - 1, F.lit(1.0))
    covered: Column = F.lit(0.0)
    if words:
        covered = 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(words, key=lambda w: (-len(w), w))), "")) / n
    common = lambda w: (F.lower(w).isin(*words) if words else F.lit(False)).cast("double")
    flag = lambda v: v.cast("double")
    found = found.withColumns(
        {
            "length": n,
            "surprise": surprise,
            "uppers": F.regexp_count(c, F.lit("[A-Z]")) / n,
            "distinct": F.size(F.array_distinct("chars")) / n,
            "covered": covered,
            "key_word": flag(F.col("before").rlike(KEY_WORDS)),
            "assigned": flag(F.col("sign") != ""),
            "quoted": flag(F.col("quote") != ""),
            "before_common": common(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*\z", 1)),
            "after_common": common(F.regexp_extract("after", r"\A[^\p{L}\p{N}]{0,4}([A-Za-z]+)", 1)),
            "after_sign": flag(F.col("after").rlike(r"\A[\"']?[ \t]*[;,)}\]#]")),
            "alone": flag((F.col("before") == "") & (F.col("sign") == "")),
            "path_depth": F.size(F.split("source", r"[/\\]")).cast("double"),
            "path_real": flag(F.col("source").rlike(PATH_REAL)),
            "path_example": flag(F.col("source").rlike(PATH_EXAMPLE)),
        }
    )
    return found.drop("chars", "codes", "table", "steps", "after")


def known_kind() -> Column:
    """1 for a value of a secret's form, 0 for a number, a value without digits or a UUID, null for what must be judged by the forest."""
    c = F.col("candidate")
    secret = (c.rlike(DIGEST) & c.rlike("[a-f]") & c.rlike("[0-9]")) | c.rlike(ISSUED)
    return F.when(secret, 1.0).when(~c.rlike("[0-9]") | ~c.rlike("[A-Za-z]") | c.rlike(UUID), 0.0)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, text, source)`` to one row per candidate: its number, length, digest, score and verdict.

    The candidate itself is not returned. Null and empty texts have no
    candidates, a null source is an empty path, repeated rows repeat their
    findings, an empty table gives an empty result. If all labels are equal
    there is nothing to learn and the label is the score; without any label,
    the score is 0. At most ``MAX_TRAIN`` findings teach, those of smallest hash.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    docs = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    counts = scratch.put(word_counts(docs), "words")
    found = scratch.put(candidates(docs), "candidates")
    rows = scratch.put(_features(found, dictionary(counts), transitions(counts)), "features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    labelled = rows.withColumn("label", known_kind()).where("label is not null") if findings is None else rows.join(findings.select("doc_id", "no", F.col("label").cast("double").alias("label")), ["doc_id", "no"])
    # in a fixed order, so the forest is the same on every run; repeated rows teach once
    labelled = labelled.select("features", "label", F.xxhash64("doc_id", "no", "candidate").alias("h")).dropDuplicates(["h"])
    taught = scratch.put(few(labelled, F.col("h"), MAX_TRAIN).coalesce(1), "taught")
    seen = {r.label for r in taught.select("label").distinct().collect()}
    out = ["doc_id", "no", F.col("length").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256")]
    if len(seen) < 2:
        return rows.withColumn("score", F.lit(next(iter(seen), 0.0))).select(*out, "score", (F.col("score") >= 0.5).alias("secret"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(taught)
    scored = forest.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*out, "score", (F.col("score") >= 0.5).alias("secret"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
