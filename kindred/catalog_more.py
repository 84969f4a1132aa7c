"""More queries of the linkage engine: transliterated channels, folds, samples, slices, grids, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CLEAN, COUNTS, CTE, DEVANAGARI_SQL, chosen_counts, pairs, q, s1, scored, sides, table, tgt, truth, truths, universe
from .functions import keys as K
from .functions import normal as N
from .llm.common import settle
from .operators import alike, blocking, decide, evaluate, features, pairing, retrieval
from .plans import linkage

_HOUSE = "regexp_replace(regexp_extract(trim(address), '[0-9]+[A-Za-z]?', 0), '^0+', '')"
_NAME = CLEAN.format(DEVANAGARI_SQL)


# ---------------------------------------------------------------- keys
@q(
    "p14_sorted_tokens_key",
    CTE
    + """, w AS (SELECT entity_id, country, list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '') AS w FROM s1),
    two AS (SELECT *, list_sort(list_transform(w, lambda x, i: {'n': -length(x), 'i': i, 't': x}))[1:2] AS t FROM w)
    SELECT entity_id, CASE WHEN len(w) > 0 THEN country || '::' || array_to_string(list_sort(list_transform(t, lambda y: y.t)), '_') END AS block_key FROM two""",
)
def _(spark, d):
    return s1(spark, d).select("entity_id", K.standard_key("name", "country", "sorted_tokens").alias("block_key"))


@q("p17_p23_accents", CTE + "SELECT entity_id, strip_accents(name) AS plain FROM s1")
def _(spark, d):
    return s1(spark, d).select("entity_id", N.remove_accents("name").alias("plain"))


@q("p24_devanagari", f"WITH x AS (SELECT doc_id, left(text, 40) || chr((2309 + doc_id % 60)::INT) || chr((2309 + doc_id % 57)::INT) AS name FROM documents) SELECT doc_id, {DEVANAGARI_SQL} AS latin FROM x")
def _(spark, d):
    sign = lambda k: F.decode(F.unhex(F.concat(F.lit("0"), F.hex(F.lit(2309) + F.col("doc_id") % k))), "UTF-16BE")
    name = F.concat(F.substring("text", 1, 40), sign(60), sign(57))
    return table(spark, d, "documents").select("doc_id", N.transliterate_devanagari(name).alias("latin"))


_MIXED = "left(text, 30) || CASE doc_id % 4 WHEN 1 THEN chr(2325) WHEN 2 THEN chr(2453) WHEN 3 THEN chr(2980) ELSE '' END"


@q(
    "p27_p30_scripts",
    f"""WITH x AS (SELECT doc_id, {_MIXED} AS t, left(text, 30) AS u, source || '-' || doc_id AS ident FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, '[\\x{{0900}}-\\x{{097F}}]') THEN 'Devanagari' WHEN regexp_matches(t, '[\\x{{0980}}-\\x{{09FF}}]') THEN 'Bengali'
      WHEN regexp_matches(t, '[\\x{{0B80}}-\\x{{0BFF}}]') THEN 'Tamil' ELSE 'Latin / Other' END AS script,
      CASE WHEN regexp_matches(t, '[\\x{{0900}}-\\x{{0D7F}}]') THEN 'Latin S1 -> Native Indic Target' ELSE 'Both Latin' END AS direction,
      NOT regexp_matches(t, '[^\\x00-\\x7F]') AS ascii_only, left(ident, 2) AS target_source FROM x""",
)
def _(spark, d):
    sign = F.element_at(F.array(*map(F.lit, ("", "\u0915", "\u0995", "\u0ba4"))), (F.col("doc_id") % 4 + 1).cast("int"))
    head = F.substring("text", 1, 30)
    x = table(spark, d, "documents").select("doc_id", F.concat(head, sign).alias("t"), head.alias("u"), F.concat("source", F.lit("-"), "doc_id").alias("ident"))
    return x.select(
        "doc_id", K.script("t").alias("script"), K.script_direction("u", "t").alias("direction"),
        K.ascii_only("t").alias("ascii_only"), K.target_source("ident").alias("target_source"),
    )


# ---------------------------------------------------------------- retrieval
@q(
    "j13_transliterated_prefix",
    CTE
    + f""", a AS (SELECT *, left(c, 2) AS p FROM (SELECT entity_id, country, {_NAME} AS c, {_HOUSE} AS h, regexp_extract(address, '{K.POSTAL}', 1) AS z FROM s1) WHERE h <> ''),
    b AS (SELECT *, left(c, 2) AS p FROM (SELECT entity_id, country, {_NAME} AS c, {_HOUSE} AS h, regexp_extract(address, '{K.POSTAL}', 1) AS z FROM tgt) WHERE h <> ''),
    u AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM a JOIN b USING (country, h, p) WHERE p <> '' AND jaro_winkler_similarity(a.c, b.c) >= 0.8
      UNION SELECT a.entity_id, b.entity_id FROM a JOIN b USING (country, h, z) WHERE country = 'en' AND z <> '')
    SELECT s1_id, target_id FROM u QUALIFY count(*) OVER (PARTITION BY s1_id) <= 50""",
)
def _(spark, d):
    return blocking.transliterated(s1(spark, d), tgt(spark, d), "en")


@q(
    "j16_sibling_names",
    CTE
    + f""", t AS (SELECT entity_id, source, country, {CLEAN.format("name")} AS k FROM tgt WHERE length({CLEAN.format("name")}) >= 1),
    o AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY country, k) <= 5)
    SELECT DISTINCT s1_id, o.entity_id AS target_id FROM pairs JOIN t ON t.entity_id = target_id JOIN o ON o.country = t.country AND o.k = t.k AND o.source <> t.source""",
)
def _(spark, d):
    return blocking.siblings(pairs(spark, d), tgt(spark, d), K.clean("name"), 1, 5)


@q(
    "j20_shared_address_tokens",
    CTE
    + f""", k AS (SELECT entity_id, country, left({_NAME}, 4) AS k, list_distinct(string_split(address, ' ')) AS w FROM s1),
    t AS (SELECT entity_id, country, left({_NAME}, 4) AS k, list_distinct(string_split(address, ' ')) AS w FROM tgt)
    SELECT k.entity_id AS s1_id, t.entity_id AS target_id FROM k JOIN t USING (country, k) WHERE k <> '' AND len(list_intersect(k.w, t.w)) >= 2""",
)
def _(spark, d):
    k = blocking.KEYS["translit4"]()
    return pairing.sharing(*sides(spark, d, w=F.col("address"), kk=F.when(k != "", F.md5(F.concat("country", F.lit("\0"), k)))), "kk", 2)


@q(
    "j21_transliterated_siblings",
    CTE
    + f""", t AS (SELECT * FROM (SELECT entity_id, source, country, {_NAME} AS k FROM tgt) WHERE length(k) >= 4)
    SELECT DISTINCT s1_id, o.entity_id AS target_id FROM pairs JOIN t ON t.entity_id = target_id JOIN t o ON o.country = t.country AND o.k = t.k AND o.source <> t.source""",
)
def _(spark, d):
    k = blocking.KEYS["translit_name"]()
    return pairing.siblings(*sides(spark, d, kk=F.when(F.length(k) >= 4, F.md5(F.concat("country", F.lit("\0"), k)))))


_TOK = "list_distinct(list_filter(string_split_regex(lower(name), '\\s+'), lambda x: length(x) >= 3))"


@q(
    "j23_token_index",
    CTE
    + f""", a AS (SELECT entity_id, country, unnest({_TOK}) AS t FROM s1), b AS (SELECT entity_id, country, unnest({_TOK}) AS t FROM tgt),
    df AS (SELECT country, t, ln(1 + (SELECT count(*) FROM tgt)::DOUBLE / count(*)) AS w FROM b GROUP BY 1, 2 HAVING count(*) <= 10000),
    p AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id, round(sum(w), 4) AS score FROM a JOIN df USING (country, t) JOIN b USING (country, t) GROUP BY 1, 2)
    SELECT s1_id, count(*) AS n, round(sum(score), 2) AS total FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) <= 30) GROUP BY 1""",
)
def _(spark, d):
    t = F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: F.length(x) >= 3))
    hits = retrieval.token_index(s1(spark, d), tgt(spark, d), t, 30, 10_000)
    return hits.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


_FOLD = "(('0x' || left(sha256('314159|' || s1_id), 15))::BIGINT % 5 + ('0x' || substr(sha256('314159|' || s1_id), 16, 1))::BIGINT)::INT % 5"


@q(
    "j26_j28_labels_and_folds",
    CTE
    + f""", folds AS (SELECT entity_id AS s1_id, {_FOLD.replace("s1_id", "entity_id")} AS fold FROM s1)
    SELECT p.s1_id, p.target_id, fold, (t.s1_id IS NOT NULL) AS label FROM pairs p JOIN folds f ON f.s1_id = p.s1_id AND f.fold <> 2
    LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.target_id = p.target_id""",
)
def _(spark, d):
    folds = universe(spark, d).select("s1_id", K.fold("s1_id").alias("fold"))
    x = linkage.label(pairs(spark, d).join(folds.where("fold <> 2"), "s1_id"), truth(spark, d))
    return x.select("s1_id", "target_id", "fold", (F.col("label") == 1).alias("label"))


@q(
    "j29_tagged_keys",
    CTE
    + """, r AS (SELECT 'S1' AS tag, entity_id, name FROM s1 UNION ALL SELECT source, entity_id, name FROM tgt),
    k AS (SELECT 'S1' AS tag, s1_id AS entity_id FROM pairs UNION SELECT left(target_id, 2), target_id FROM pairs)
    SELECT tag, entity_id, md5(name) AS name_md5 FROM k JOIN r USING (tag, entity_id)""",
)
def _(spark, d):
    records = s1(spark, d).select(F.lit("S1").alias("tag"), "entity_id", "name").unionByName(tgt(spark, d).select(F.col("source").alias("tag"), "entity_id", "name"))
    p = pairs(spark, d)
    wanted = p.select(F.lit("S1").alias("tag"), F.col("s1_id").alias("entity_id")).unionByName(p.select(K.target_source("target_id").alias("tag"), F.col("target_id").alias("entity_id"))).distinct()
    return wanted.join(records, ["tag", "entity_id"]).select("tag", "entity_id", F.md5("name").alias("name_md5"))


@q(
    "j35_random_pairs",
    CTE
    + """, x AS (SELECT entity_id, ('0x' || substr(sha256(entity_id), 17, 8))::BIGINT % 100 AS r FROM s1 ORDER BY sha256(entity_id) LIMIT 1000),
    y AS (SELECT entity_id, ('0x' || substr(sha256(entity_id), 17, 8))::BIGINT % 100 AS r FROM tgt ORDER BY sha256(entity_id) LIMIT 1000)
    SELECT x.entity_id AS s1_id, y.entity_id AS target_id FROM x JOIN y USING (r)""",
)
def _(spark, d):
    return blocking.random_pairs(s1(spark, d), tgt(spark, d))


# ---------------------------------------------------------------- features
@q("s1_s6_compact_features")
def _(spark, d):
    return alike.compact(*sides(spark, d, **alike.compact_columns()))


@q("s8_interactions", CTE + """SELECT s1_id, target_id, round(jaro_winkler_similarity(a.name, b.name) * jaro_winkler_similarity(a.address, b.address) / 10000.0, 6) AS jw,
    CASE WHEN a.name <> '' AND a.name = b.name AND a.address <> '' AND a.address = b.address THEN 1.0 ELSE 0.0 END::DOUBLE AS exact FROM pairs JOIN s1 a ON a.entity_id = s1_id JOIN tgt b ON b.entity_id = target_id""")
def _(spark, d):
    return alike.interactions(*sides(spark, d, **alike.record_columns()))


# ---------------------------------------------------------------- evaluation
@q("a9_any_match", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


_SLICES = {
    "all": "TRUE", "no_truth": "a = 0", "one_truth": "a = 1", "many_truths": "a >= 2", "crowd": "a >= 10", "predicted": "p > 0", "silent": "p = 0",
    "over": "p > a", "under": "p < a", "exact": "p = a AND tp = a", "wrong": "p > 0 AND tp = 0", "partial": "tp > 0 AND tp < a", "noisy": "p > tp",
}
_CHOSEN9 = ", chosen AS (SELECT * FROM scored WHERE score >= 0.9)" + COUNTS


@q(
    "a17_slices",
    CTE
    + _CHOSEN9
    + ", z AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS slice, * FROM f WHERE {c}" for n, c in _SLICES.items())
    + """) SELECT slice, count(*) AS entities, round(avg(f), 9) AS macro_f05, min(f) AS least, max(f) AS greatest,
    sum(a)::BIGINT AS truths, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM z GROUP BY 1""",
)
def _(spark, d):
    return evaluate.slices(chosen_counts(spark, *sides(spark, d), 900_000), {n: F.expr(c) for n, c in _SLICES.items()}).withColumn("macro_f05", F.round("macro_f05", 9))


@q("m3_micro_scores", CTE + _CHOSEN9 + """SELECT round(sum(tp)::DOUBLE / sum(p), 9) AS micro_precision, round(sum(tp)::DOUBLE / sum(a), 9) AS micro_recall,
    round(5.0 * sum(tp)::DOUBLE / (sum(a) + 4.0 * sum(p)), 9) AS micro_f05 FROM f""")
def _(spark, d):
    s = evaluate.score(evaluate.entity_counts(universe(spark, d), truth(spark, d), scored(spark, d).where("score >= 0.9")))
    return s.select(*(F.round(c, 9).alias(c) for c in ("micro_precision", "micro_recall", "micro_f05")))


_FEW = ", few AS (SELECT s.entity_id AS s1_id, t.entity_id AS target_id FROM ke s JOIN kt t ON s.country = t.country AND left(s.k, 9) = left(t.k, 9) AND s.a = t.a WHERE s.a <> '' AND t.entity_id LIKE 'S2%')"


def _few(spark, d):
    side = lambda df, i: df.select(F.col("entity_id").alias(i), "country", F.substring(K.clean("name"), 1, 9).alias("k"), F.trim("address").alias("a")).where("a <> ''")
    right = side(tgt(spark, d), "target_id").where("target_id like 'S2%'")
    return side(s1(spark, d), "s1_id").join(right, ["country", "k", "a"]).select("s1_id", "target_id")


@q("m5_missed_pairs", CTE + _FEW + """, g AS (SELECT DISTINCT s1_id, target_id FROM truth EXCEPT SELECT s1_id, target_id FROM few), h AS (SELECT * FROM g ORDER BY s1_id, target_id LIMIT 50)
    SELECT h.*, md5(a.name) AS s1_name, md5(b.name) AS tgt_name, md5(a.address) AS s1_address, md5(b.address) AS tgt_address FROM h JOIN s1 a ON a.entity_id = s1_id JOIN tgt b ON b.entity_id = target_id""")
def _(spark, d):
    x = evaluate.missed_pairs(truth(spark, d), _few(spark, d), s1(spark, d), tgt(spark, d))
    return x.select("s1_id", "target_id", *(F.md5(c).alias(c) for c in ("s1_name", "tgt_name", "s1_address", "tgt_address")))


@q("m6_labelled_sample", CTE + """, x AS (SELECT p.*, (t.s1_id IS NOT NULL)::INT AS label FROM pairs p LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.target_id = p.target_id)
    SELECT s1_id, target_id, label FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(s1_id || '|' || target_id)) <= CASE WHEN label = 1 THEN 100 ELSE 200 END""")
def _(spark, d):
    x = pairing.every(*sides(spark, d)).withColumn("label", F.col("same").cast("int"))
    return evaluate.labelled_sample(x, 100, 200).select("s1_id", "target_id", "label")


@q(
    "m16_margin_grid",
    CTE
    + """, g AS (SELECT t AS threshold, m AS margin FROM (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS t), (SELECT unnest([0.0, 0.05, 0.2])::DOUBLE AS m)),
    a AS (SELECT s1_id, count(*) AS a FROM truth GROUP BY 1), x AS (SELECT s.*, round(max(score) OVER (PARTITION BY s.s1_id) - score, 9) AS gap, t.s1_id IS NOT NULL AS t FROM scored s LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.target_id = s.target_id),
    e AS (SELECT entity_id, threshold, margin, coalesce(any_value(a.a), 0) AS a, count(x.s1_id) AS p, coalesce(sum(x.t::INT), 0) AS tp FROM s1 CROSS JOIN g LEFT JOIN a ON a.s1_id = entity_id
      LEFT JOIN x ON x.s1_id = entity_id AND x.score >= threshold AND x.gap <= margin GROUP BY 1, 2, 3)
    SELECT threshold, margin, round(avg(CASE WHEN a = 0 AND p = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 5.0 * tp / (a + 4.0 * p) END::DOUBLE), 9) AS macro_f05, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    left, right = sides(spark, d)
    top = pairing.best(left, right, 1).groupBy(F.col("s1_id").alias("id")).agg(F.max("s").alias("best"))
    cells = [(t, m) for t in (0.5, 0.7, 0.9) for m in (0.0, 0.05, 0.2)]
    n = pairing.counts(settle(left.join(top, "id")), right, [(round(t * pairing.UNIT), round(m * pairing.UNIT)) for t, m in cells])
    x = evaluate.margin_grid_of(left.select(F.col("id").alias("s1_id")), truths(left), n, cells)
    return x.withColumn("macro_f05", F.round("macro_f05", 9))


@q("m26_lengths_by_country", "SELECT lang, least(length(split_part(text, chr(10), 1)) // 50, 20)::BIGINT AS band, left(upper(text), 1) AS initial, count(*) AS n FROM documents GROUP BY 1, 2, 3")
def _(spark, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").groupBy("lang", F.least(F.floor(F.length(first) / 50), F.lit(20)).alias("band"), K.initial("text").alias("initial")).agg(F.count(F.lit(1)).alias("n"))


_BAD = ["(doc_id % 7 <> 0)", "(doc_id % 11 = 0)", "(doc_id % 13 = 0)", "(doc_id % 17 = 0)", "(doc_id % 19 = 0)"]


@q(
    "m31_validate_submission",
    CTE
    + f""", o AS (SELECT 'S1-' || doc_id AS s1_id, doc_id, source || '-' || doc_id AS good FROM base),
    sub AS (SELECT s1_id, doc_id, good || CASE WHEN {_BAD[2]} THEN ',S4-x' ELSE '' END || CASE WHEN {_BAD[3]} THEN ',' || good ELSE '' END || CASE WHEN {_BAD[4]} THEN ',S2-999999999' ELSE '' END AS m FROM o WHERE {_BAD[0]}),
    allrows AS (SELECT s1_id, m FROM sub UNION ALL SELECT s1_id, m FROM sub WHERE {_BAD[1]} UNION ALL SELECT 'S1-x' || doc_id, good FROM o WHERE doc_id < 5),
    ids AS (SELECT s1_id, unnest(string_split(m, ',')) AS t FROM allrows)
    SELECT 'duplicate_rows' AS check, (SELECT count(*) FROM (SELECT s1_id FROM allrows GROUP BY 1 HAVING count(*) > 1)) AS failures
    UNION ALL SELECT 'null_ids', (SELECT count(*) FROM allrows WHERE s1_id IS NULL)
    UNION ALL SELECT 'missing_rows', (SELECT count(*) FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM allrows))
    UNION ALL SELECT 'unknown_rows', (SELECT count(*) FROM allrows WHERE s1_id NOT IN (SELECT entity_id FROM s1))
    UNION ALL SELECT 'duplicate_matches', (SELECT count(*) FROM (SELECT s1_id, t FROM ids GROUP BY 1, 2 HAVING count(*) > 1))
    UNION ALL SELECT 'malformed_ids', (SELECT count(*) FROM ids WHERE NOT regexp_full_match(t, 'S[23]-[0-9]+'))
    UNION ALL SELECT 'unknown_targets', (SELECT count(*) FROM ids WHERE t NOT IN (SELECT entity_id FROM tgt))""",
)
def _(spark, d):
    t = tgt(spark, d).select("entity_id", F.substring_index("entity_id", "-", -1).cast("long").alias("doc_id"))
    extra = lambda cond, x: F.when(F.expr(cond), x).otherwise("")
    listed = F.concat("entity_id", extra(_BAD[2], F.lit(",S4-x")), extra(_BAD[3], F.concat(F.lit(","), "entity_id")), extra(_BAD[4], F.lit(",S2-999999999")))
    sub = t.where(_BAD[0]).select(F.concat(F.lit("S1-"), "doc_id").alias("s1_id"), listed.alias("matched_entity_ids"), "doc_id")
    stray = t.where("doc_id < 5").select(F.concat(F.lit("S1-x"), "doc_id").alias("s1_id"), F.col("entity_id").alias("matched_entity_ids"), "doc_id")
    every = sub.unionByName(sub.where(_BAD[1])).unionByName(stray).drop("doc_id")
    return decide.validate(every, universe(spark, d), tgt(spark, d))


# ---------------------------------------------------------------- order, lists
@q("o1_o2_custom_order", "SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INT AS place FROM orders GROUP BY 1")
def _(spark, d):
    from pyspark.sql import Window as W

    order = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(W.orderBy(order))).orderBy("place")


@q("u2_positions", "SELECT doc_id, unnest(generate_series(0, len(w) - 1))::INT AS position, md5(unnest(w)) AS word FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ') AS w FROM documents)")
def _(spark, d):
    words = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")
    return table(spark, d, "documents").select("doc_id", F.posexplode(words).alias("position", "word")).withColumn("word", F.md5("word"))


@q("d15_quantile_grid", CTE + """, th AS (SELECT unnest(quantile_cont(score, [0.02, 0.25, 0.5, 0.75])) AS threshold FROM scored)
    SELECT round(threshold, 9) AS threshold, count(*) AS predicted FROM (SELECT DISTINCT threshold FROM th) JOIN scored ON score >= threshold GROUP BY 1""")
def _(spark, d):
    s = settle(pairing.histogram(*sides(spark, d)).where("score is not null"))
    cuts = s.agg(F.percentile("score", F.array(*map(F.lit, (0.02, 0.25, 0.5, 0.75))), F.col("n")).alias("t")).select(F.explode("t").alias("threshold")).distinct()  # four rows
    x = s.join(F.broadcast(cuts), F.col("score") >= F.col("threshold"))
    return x.groupBy(F.round("threshold", 9).alias("threshold")).agg(F.sum("n").alias("predicted"))


