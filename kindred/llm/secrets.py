"""Secret scan, native: candidates by pattern, false positives removed by a random forest.

Everything runs as DataFrame expressions and Spark ML: texts without a candidate are dropped by one
pattern; candidates of the rest come with the word before them; length, character transitions,
dictionary coverage, path and neighbouring words are column expressions; the forest is trained
from labelled findings, by default a table generated by ``labelled_findings`` (bounded by
TRAIN_ROWS), and drops candidates it holds for something else.

Defined results: null and empty texts have no candidates; a candidate that occurs several times in
a text is one finding; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_ROWS = 6000

_BODY = "A-Za-z0-9+/_=-"
#: shortest secret
LEAST = 12
CANDIDATE = rf"(?<![{_BODY}])[{_BODY}]{{{LEAST},}}"
#: what stands before a candidate, at the end of a text
CONTEXT = rf"(?:\S{{1,40}}\s+(?:[=:]\s+)?)?[^\s{_BODY}]{{0,8}}\z"
#: characters before a candidate in which its context is looked for
WINDOW = 128
#: words of ordinary names and fillers (fixed values)
DICTIONARY = ("example", "sample", "dummy", "test", "demo", "placeholder", "changeme", "version", "release", "build", "file", "page", "image", "index", "user", "name", "the", "and", "ing", "tion", "ment", "xxxx", "0000", "1234")
SECRET_WORDS = "(?i)(key|token|secret|passw|pwd|auth|credential|bearer|api|private)"
OTHER_WORDS = "(?i)(sha|md5|hash|commit|checksum|digest|uuid|guid|isbn|order|card|number|version|revision|id)"
FEATURES = ("size", "digits", "upper", "lower", "changes", "distinct_chars", "hex", "only_digits", "covered", "path", "dashes", "keyed", "near_secret", "near_other", "cloud_key")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, before, secret``: each distinct candidate of a text with what precedes it. Texts are
    split at candidates, so one may be the word before the next and is found all the same."""
    found = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    found = found.select("doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("kd_runs"), F.split("text", CANDIDATE, -1).alias("kd_gaps"))
    ahead = F.concat(F.array(F.lit("")), "kd_runs")
    found = found.select("doc_id", F.explode(F.arrays_zip("kd_runs", ahead.alias("kd_ahead"), "kd_gaps")).alias("kd"))
    found = found.select("doc_id", F.col("kd.kd_runs").alias("kd_run"), F.concat(F.right("kd.kd_ahead", F.lit(40)), F.right("kd.kd_gaps", F.lit(WINDOW))).alias("kd_gap")).where("kd_run is not null")
    found = found.select("doc_id", F.concat(F.regexp_extract("kd_gap", CONTEXT, 0), "kd_run").alias("kd_span"))
    return split_span(found, "doc_id").dropDuplicates(["doc_id", "before", "secret"])


def split_span(spans: DataFrame, *keep: str) -> DataFrame:
    """A span ``word name=value`` as what stands before and the value; a name joined to the value by
    an equals sign belongs to what stands before."""
    span = spans.withColumn("kd_run", F.regexp_extract("kd_span", rf"[{_BODY}]+\z", 0))
    named = F.regexp_extract("kd_run", r"\A([A-Za-z_-]+=)(?=[^=])", 1)
    span = span.withColumn("secret", F.regexp_replace("kd_run", r"\A[A-Za-z_-]+=(?=[^=])", ""))
    before = F.concat(F.expr("substring(kd_span, 1, length(kd_span) - length(kd_run))"), named)
    return span.select(*keep, F.trim(before).alias("before"), "secret").where(F.length("secret") >= LEAST)


def featurise(found: DataFrame) -> DataFrame:
    """``found`` with a column for each of FEATURES, all doubles."""
    s, n = F.col("secret"), F.length("secret")
    share = lambda pattern: F.regexp_count(s, F.lit(pattern)) / n
    flag = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False)).cast("double")
    made = {
        "size": n, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "changes": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
        "distinct_chars": F.size(F.array_distinct(F.split("secret", ""))) / n,
        "hex": flag("secret", r"\A[0-9a-fA-F]+\z"), "only_digits": flag("secret", r"\A[0-9=-]+\z"),
        "covered": 1 - F.length(F.regexp_replace(F.lower("secret"), "|".join(DICTIONARY), "")) / n,
        "path": (F.col("secret").rlike("/[a-z]+/|[.]/|/[.]") | F.col("before").rlike(r"[/\\.]\z")).cast("double"),
        "dashes": share("[-_]"), "keyed": flag("before", r"[=:][\s\"']*\z"),
        "near_secret": flag("before", SECRET_WORDS), "near_other": flag("before", OTHER_WORDS), "cloud_key": flag("secret", r"\A(AKIA|ASIA)[0-9A-Z]{16}\z"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """``before, secret, label``: findings of known kind, made from hashes of a counter."""
    i = F.col("id")
    h = F.sha2(F.concat(F.lit("finding/"), i.cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[+/]", "Q")
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(F.reverse(h))), 1, 16), "+/=", "XYZ"))
    low = F.translate(h, "0123456789", "ghijklmnop")
    mixed = F.translate(b64, "0123456789", "qWxYzRtVbN")
    word = F.concat(*(F.element_at(F.array(*map(F.lit, ("re", "con", "ver", "sta", "mi", "lo", "tra", "be", "ung", "ous", "der", "pre"))), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(12)).cast("int") + 1) for k in range(6)))
    kinds = [  # before, secret, label
        (F.lit('token = "'), F.substring(h, 1, 40), 1), (F.lit("password="), F.substring(h, 1, 18), 1), (F.lit("api_key:"), F.substring(b64, 1, 32), 1), (F.lit("secret ="), F.substring(b64, 5, 40), 1),
        (F.lit(""), F.concat(F.lit("AKIA"), upper), 1), (F.lit("the"), F.concat(F.lit("AKIA"), upper), 1), (F.lit("Bearer"), F.substring(b64, 2, 44), 1), (F.lit("auth_token="), F.substring(b64, 1, 24), 1),
        (F.lit("commit"), F.substring(h, 1, 40), 0), (F.lit("sha256:"), F.substring(h, 1, 64), 0), (F.lit("md5 ="), F.substring(h, 1, 32), 0),
        (F.lit("the"), F.translate(F.substring(h, 1, 16), "abcdef", "123456"), 0), (F.lit("card"), F.translate(F.substring(h, 9, 16), "abcdef", "789012"), 0),
        (F.lit("key"), F.concat(F.lit("example_key_"), F.substring(h, 1, 4)), 0), (F.lit("token ="), F.lit("xxxxxxxxxxxxxxxx1234"), 0), (F.lit("in"), F.concat(F.lit("release-version-"), F.substring(h, 1, 3)), 0),
        (F.lit("see"), F.concat(F.lit("images/page/file"), F.substring(h, 1, 2)), 0), (F.lit("uuid"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 12)), 0),
        (F.lit("and"), F.concat(F.lit("thetionmentingand"), F.substring(h, 1, 1), F.lit("2")), 0), (F.lit("id"), F.translate(F.substring(h, 3, 20), "abcdef", "345678"), 0),
        # without a digit
        (F.lit(""), F.concat(F.lit("AKIA"), F.upper(F.substring(low, 1, 16))), 1), (F.lit("key"), F.concat(F.lit("ASIA"), F.upper(F.substring(low, 9, 16))), 1), (F.lit("password="), F.substring(mixed, 3, 16), 1), (F.lit("secret ="), F.substring(mixed, 7, 28), 1),
        (F.lit("the"), word, 0), (F.lit("der"), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 40)), 0), (F.lit(""), F.upper(word), 0), (F.lit("key"), word, 0), (F.lit("token:"), word, 0),
        (F.lit("a"), F.concat(F.substring(word, 1, 7), F.lit("-"), F.substring(word, 4, 9)), 0), (F.lit("in"), F.concat_ws("_", F.substring(word, 1, 5), F.lit("key"), F.substring(word, 6, 6)), 0),
        (F.lit("see"), F.concat(F.lit("/"), F.substring(word, 1, 5), F.lit("/"), F.substring(word, 6, 7), F.lit("/")), 0), (F.lit(""), F.repeat(F.element_at(F.array(*map(F.lit, "-=_")), F.pmod(F.xxhash64(i), F.lit(3)).cast("int") + 1), F.lit(12) + F.pmod(i, F.lit(7)).cast("int")), 0),
    ]
    pick = F.pmod(i, F.lit(len(kinds)))
    before, secret, label = F.lit(""), F.lit(""), F.lit(0)
    for k, (b, s, y) in enumerate(kinds):
        before, secret, label = F.when(pick == k, b).otherwise(before), F.when(pick == k, s).otherwise(secret), F.when(pick == k, F.lit(y)).otherwise(label)
    return spark.range(0, rows, 1, 2).select(before.alias("before"), secret.alias("secret"), label.cast("double").alias("label"))


def train(findings: DataFrame) -> RandomForestClassificationModel:
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="kd_features").transform(featurise(findings))
    return RandomForestClassifier(featuresCol="kd_features", labelCol="label", predictionCol="kd_prediction", rawPredictionCol="kd_raw", probabilityCol="kd_probability", numTrees=24, maxDepth=7, seed=11).fit(ready)


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``doc_id, before, secret, probability`` of each candidate that the forest holds for a secret."""
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="kd_features").transform(featurise(candidates(docs)))
    scored = model.transform(ready).withColumn("probability", F.round(vector_to_array("kd_probability")[1], 6))
    return scored.where(F.col("probability") >= least).select("doc_id", "before", "secret", "probability")
