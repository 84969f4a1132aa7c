"""Golden rows and invariants of the linkage operators."""

import pytest
from pyspark.sql import functions as F

from kindred import catalog
from kindred.functions import keys as K
from kindred.functions import normal as N
from kindred.functions import similarity as S
from kindred.operators import blocking, decide, evaluate, retrieval
from kindred.sources import tables


def _one(spark, value, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], "v string").select(fn("v")).collect()]


def test_house_numbers(spark):
    vals = ["2nd", "no407", "55industrial", "s70w22100", "12A", "007", "12-14", "", None, "aßc12", "١٢٣", "  123  "]
    assert _one(spark, vals, K.house) == ["2n", "407", "55i", "70w", "12A", "007", "12", "", None, "12", "", "123"]
    assert _one(spark, ["2nd", "no407", "12A", "  123  "], lambda c: K.house(c, "word")) == ["", "", "12A", "123"]
    assert _one(spark, ["007", "000"], K.house_norm) == ["7", ""]


def test_entity_scores(spark):
    cases = [("", "", 1.0), ("B", "", 0.0), ("", "A", 0.0), ("A", "A", 1.0), ("AB", "A", 5 / 9), ("A", "AB", 5 / 6), ("AB", "AC", 0.5), ("ABC", "ABCD", 15 / 16)]
    u = spark.createDataFrame([(str(i),) for i in range(8)], "s1_id string")
    t = spark.createDataFrame([(str(i), x) for i, (_, a, _) in enumerate(cases) for x in a], "s1_id string, target_id string")
    p = spark.createDataFrame([(str(i), x) for i, (q, _, _) in enumerate(cases) for x in q], "s1_id string, target_id string")
    c = evaluate.entity_counts(u, t, p)
    got = {r["s1_id"]: r["f"] for r in c.withColumn("f", evaluate.f05()).collect()}
    assert all(got[str(i)] == pytest.approx(f, abs=1e-12) for i, (_, _, f) in enumerate(cases))
    s = evaluate.score(c).first()
    assert s["macro_f05"] == pytest.approx(4.826389 / 8, abs=1e-6) and (s["tp"], s["fp"], s["fn"]) == (7, 3, 4) and s["micro_precision"] == pytest.approx(0.7)


def test_similarities(spark):
    assert S.jaro_winkler_value("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and S.jaro_winkler_value("abcdefgh", "abxyzqwr") == 0.5
    assert S.jaro_winkler_value("abcdefgh", "abcxyzqw") == pytest.approx(0.583333, abs=1e-6) and S.jaro_winkler_value("éa", "êa") == pytest.approx(0.8) and S.jaro_winkler_value("", "") == 0.0
    assert S.jaro_winkler_points("abcdefgh", "abcxyzqw") == pytest.approx(0.708333, abs=1e-6) and S.jaro_winkler_points("éa", "êa") == pytest.approx(0.666667, abs=1e-6)
    df = spark.createDataFrame([("aab", "abc", 2 / 3), ("ab", "ba", 1.0), ("hello world", "hola mundo", 0.416667), ("é", "ê", 1 / 3), ("", "a", 0.0)], "a string, b string, w double")
    assert all(r["x"] == pytest.approx(r["w"], abs=1e-6) for r in df.withColumn("x", S.byte_jaccard("a", "b")).collect())
    one = spark.createDataFrame([(["a", "b"], ["b", "c", "d"], [])], "a array<string>, b array<string>, e array<string>")
    assert one.select(S.token_jaccard("a", "b"), S.token_overlap("a", "b"), S.token_jaccard("a", "e"), S.token_overlap("e", "b")).first()[:] == (0.25, 0.5, 0.0, 0.0)


def test_fold_and_ids(spark):
    assert _one(spark, ["S1-1"], K.fold) == [4]
    assert _one(spark, ["S2-1,S3-2", "['S2-1', 'S3-2']", "S2-1|S3-2", "S,2,-,1", ""], tables.id_list) == [["S2-1", "S3-2"]] * 3 + [["S2-1"], []]
    t = spark.createDataFrame([("S1-1", "S2-1, S3-2"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(r["matched_entity_id"] for r in tables.truth_pairs(t).collect()) == ["S2-1", "S3-2"]
    assert [len(r["matched"]) for r in tables.truth_lists(t).orderBy("source1_entity_id").collect()] == [2, 0, 0]


def test_normalisers(spark):
    names = ["<< Team Ecole", "SARL Moncada Léarning Center", "Acme Limited Liability Company", "Foo Pvt. Ltd.", None, "  ", "B+ Retail Inc"]
    assert _one(spark, names, N.business_name) == ["team ecole", "sarl moncada learning center", "acme ltd liability co", "foo pvt ltd", "", "", "b retail inc"]
    assert _one(spark, ["1 Ivanhoe Ave, PO Box 6009", "1795 Westchester Drive, Unit G"], N.address) == ["1 ivanhoe ave pobox 6009", "1795 westchester dr unit g"]
    assert _one(spark, ["India", None, "Peru"], N.country) == ["IN", "UNKNOWN", "PERU"]
    assert _one(spark, ["राम"], N.transliterate_devanagari) == ["ram"] and _one(spark, ["राम मार्केटिंग"], N.transliterate_raw) == ["rama marketinga"]
    assert _one(spark, ["राम", "abc"], K.script) == ["Devanagari", "Latin / Other"]


def test_caps_are_inclusive(spark):
    p = spark.createDataFrame([("a", str(i)) for i in range(5)] + [("b", str(i)) for i in range(6)], "s1_id string, target_id string")
    assert {r["s1_id"] for r in blocking.cap_fanout(p, 5).collect()} == {"a"}


def test_order_of_cap_and_exclusivity(spark):
    x = spark.createDataFrame([("a", "S2-1", "S2", 0.9), ("a", "S2-2", "S2", 0.8), ("b", "S2-1", "S2", 0.95)], "s1_id string, target_id string, source string, score double")
    assert {(r["s1_id"], r["target_id"]) for r in decide.exclusive(decide.top(x, 1)).collect()} == {("b", "S2-1")}
    assert {(r["s1_id"], r["target_id"]) for r in decide.top(decide.exclusive(x), 1).collect()} == {("a", "S2-2"), ("b", "S2-1")}
    none = x.withColumn("score", F.lit(None).cast("double")).withColumn("position", F.lit(1))
    assert decide.resolve_claims(none).count() == 3


def test_rule_expected_keeps_the_best_prefix(spark):
    x = spark.createDataFrame([("a", "S2-1", "S2", 0.9, 0, 0.9), ("a", "S2-2", "S2", 0.1, 1, 0.9), ("b", "S2-3", "S2", 0.02, 0, 0.02)], "s1_id string, target_id string, source string, score double, rank int, smax double")
    assert [(r["s1_id"], r["target_id"]) for r in decide.rule_expected(x.withColumn("prob", F.col("score"))).collect()] == [("a", "S2-1")]


def test_nested_threshold_prefers_lower_of_equals(spark):
    s = spark.createDataFrame([(f, t, 10, 5.0, 0.5) for f in (0, 1) for t in (0.3, 0.6)], "fold int, threshold double, entities long, f_sum double, macro_f05 double")
    assert {r["threshold"] for r in evaluate.nested(s).collect()} == {0.3}


def test_tfidf_of_equal_texts_is_one(spark):
    df = spark.createDataFrame([("S1-1", "x", "red car fast"), ("S1-2", "x", "blue sky")], "entity_id string, country string, name string")
    t = df.withColumn("entity_id", F.regexp_replace("entity_id", "S1", "S2"))
    got = retrieval.tfidf_top_k(df, t, retrieval.word_ngrams(F.col("name")), 5).collect()
    assert {(r["s1_id"], r["target_id"], r["score"]) for r in got} == {("S1-1", "S2-1", 1.0), ("S1-2", "S2-2", 1.0)}


def test_char3_keeps_common_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    texts = [f"common name {'abcdefghij'[i % 10]}{'klm'[i % 3]} ltd\n{i} road" for i in range(40)]
    rows = [(i, t, "en" if i % 4 else "fr", "abcd" if i % 2 else "abc", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["s1_id"], r["target_id"], r["rank"]): r["score"] for r in catalog.queries()["j25_tfidf_char3"](spark, str(tmp_path)).collect()}
    a, b = catalog.s1(spark, str(tmp_path)), catalog.tgt(spark, str(tmp_path))
    want = {(r["s1_id"], r["target_id"], r["rank"]): r["score"] for r in retrieval.tfidf_top_k(a, b, retrieval.char_ngrams(F.lower("name")), 5, 1.0, 2).collect()}
    assert len(got) == 200 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "A", None, "US"), ("S1-2", "NA", "x", "IN")], tables.ENTITY)
    tables.write_tsv(df, str(tmp_path / "t"), single=True)
    back = tables.read_tsv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert tables.read_tsv(spark, str(tmp_path / "t"), null_values=("NA",)).where("business_name is null").count() == 1
    (tmp_path / "a.part_0").write_bytes(b"entity_id\tbusi")
    (tmp_path / "a.part_1").write_bytes(b"ness_name\n1\t2\n")
    assert open(tables.merge_parts([str(tmp_path / "a.part_1"), str(tmp_path / "a.part_0")], str(tmp_path / "a"))).read() == "entity_id\tbusiness_name\n1\t2\n"
    assert tables.fingerprint(df, "entity_id").first() == tables.fingerprint(df.orderBy(F.desc("entity_id")), "entity_id").first()
    assert tables.resume(df, str(tmp_path / "p")).count() == 2 and tables.resume(df.limit(1), str(tmp_path / "p")).count() == 2
    assert tables.find_columns(back)["s1"] == ["entity_id"]


def test_streaming_link(spark, tmp_path):
    from kindred.streaming.incremental import link_stream

    rows = spark.createDataFrame([("S1-1", "Acme Co", "1 Road", "US")], "entity_id string, name string, address string, country string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    target = rows.withColumn("entity_id", F.lit("S2-9"))
    run = link_stream(stream, target).writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [tuple(r) for r in spark.table("linked").collect()] == [("S1-1", "S2-9")]


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_ngrams_of_long_and_short_texts(spark):
    from kindred.functions import similarity as S

    df = spark.createDataFrame([("abab",), ("é",), ("",), (None,), ("xy" * 20000,)], "t string")
    got = [r[0] for r in df.select(S.ngrams("t", 3)).collect()]
    assert got[:3] == [["aba", "bab"], ["é"], []] and not got[3] and sorted(got[4]) == ["xyx", "yxy"]


def test_compact_features_of_records(spark):
    from kindred.operators import features

    kind = "entity_id string, name string, address string, country string"
    a = spark.createDataFrame([("S1-1", "Acme Limited", "12 Main Street", "US"), ("S1-2", "", None, "FR")], kind)
    b = spark.createDataFrame([("S2-1", "ACME Ltd.", "12 Main St", "us"), ("S2-2", "Other", "7 Rue X", "FR")], kind)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "s1_id string, target_id string")
    rows = {r["s1_id"]: r for r in features.compact(pairs, a, b).collect()}
    x, y = rows["S1-1"], rows["S1-2"]
    assert x["name_exact_match"] == x["name_jaccard"] == x["name_trigram_jaccard"] == x["name_seq_ratio"] == x["address_exact_match"] == x["address_number_match"] == x["country_match"] == 1.0
    assert y["name_exact_match"] == y["name_jaccard"] == y["name_trigram_jaccard"] == y["address_number_match"] == 0.0


def test_transliterated_channels(spark):
    from kindred.operators import blocking

    kind = "entity_id string, name string, address string, country string"
    a = spark.createDataFrame([("S1-1", "kamal", "12 Marg 110001", "India"), ("S1-2", "zz", "9 Road 110002", "India"), ("S1-3", "kamal", "12 Marg", "US")], kind)
    b = spark.createDataFrame([("S2-1", "कामल", "12 Marg", "India"), ("S2-2", "other", "9 Road 110002", "India"), ("S2-3", "other", "12 x", "US")], kind)
    got = {tuple(r) for r in blocking.transliterated(a, b, similar=0.7).collect()}
    assert got == {("S1-1", "S2-1"), ("S1-2", "S2-2")}
    assert [tuple(r) for r in blocking.shared_address_tokens(a, b).collect()] == []  # "kaml" and "kama" differ
    assert blocking.candidates(a.where("name = 'kamal'"), a.withColumn("entity_id", a.name), blocking.RULES["E2_name5"]).count() == 2


def test_slices_samples_and_grid(spark):
    from pyspark.sql import functions as F

    from kindred.operators import evaluate

    counts = spark.createDataFrame([(0, 0, 0), (2, 1, 1), (1, 3, 0)], "a long, p long, tp long")
    got = {r["slice"]: r for r in evaluate.slices(counts, {"all": F.lit(True), "none": F.col("a") == 0, "never": F.col("a") > 9}).collect()}
    assert set(got) == {"all", "none"} and got["all"]["entities"] == 3 and got["all"]["least"] == 0.0 and got["none"]["macro_f05"] == 1.0
    lab = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", int(i < 5)) for i in range(30)], "s1_id string, target_id string, label int")
    assert sorted(r[0] for r in evaluate.labelled_sample(lab, 3, 7).groupBy("label").count().select("count").collect()) == [3, 7]
    u = spark.createDataFrame([("x",), ("y",)], "s1_id string")
    t = spark.createDataFrame([("x", "t1")], "s1_id string, target_id string")
    s = spark.createDataFrame([("x", "t1", 0.9), ("x", "t2", 0.85)], "s1_id string, target_id string, score double")
    grid = {(r["threshold"], r["margin"]): round(r["macro_f05"], 6) for r in evaluate.margin_grid(u, t, s, [0.8, 0.95], [0.0, 0.1]).collect()}
    assert grid == {(0.8, 0.0): 1.0, (0.8, 0.1): round((5 / 9 + 1) / 2, 6), (0.95, 0.0): 0.5, (0.95, 0.1): 0.5}


def test_inferred_read_and_manifest(spark, tmp_path):
    import json

    from kindred.sources import tables

    (tmp_path / "a.csv").write_text("id,score,name\n1,0.5,x\n2,1.5,y\n")
    df = tables.read_inferred(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "int", "score": "double", "name": "string"} and df.count() == 2
    tables.write_manifest(spark, str(tmp_path / "m"), {"rows": 2, "source": "a.csv"})
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"rows": 2, "source": "a.csv"}


def test_id_lists_with_other_text_and_fingerprints_of_nulls(spark):
    from kindred.sources import tables

    assert _one(spark, ["S2-1 (dup)", "S1-4,S2-5", "S3-2"], tables.id_list) == [["S2-1"], ["S2-5"], ["S3-2"]]
    assert _one(spark, ["S2-1 (dup)", "S1-4,S2-5", "S3-2"], tables.id_list_junk) == ["dup", "S1-4", ""]
    print_of = lambda rows: tables.fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["digest"]
    assert len({print_of([r]) for r in ((None, "x"), ("x", None), ("x", ""), ("", "x"), (None, None), ("", ""))}) == 6


def test_initials_are_single_capitals(spark):
    assert _one(spark, ["ßtraße", "éa", "ŉ", "ᾀ", "ﬁn", "a b", "9", "", None], K.initial) == ["ẞ", "É", "ŉ", "ᾈ", "ﬁ", "A", "9", "", None]


def _pairs_by_blocks(spark, monkeypatch, piece=3, face=4):
    """Sides with large and small groups, keys missing, sizes missing; all pairs by plain Python."""
    from kindred.operators import pairing

    monkeypatch.setattr(pairing, "PIECE", piece), monkeypatch.setattr(pairing, "FACE", face), monkeypatch.setattr(pairing, "SLICE", 16)
    rows = [(i, "ab"[i % 2] if i % 7 else None, "xyz"[i % 3] if i % 5 else None, None if i % 11 == 3 else 0 if i % 13 == 5 else 100 + i * i % 37, f"c{i % 9}", i) for i in range(40)]
    kind = "id string, e string, b string, n long, c string, d long"
    a, b = (spark.createDataFrame([(f"{p}-{i}", *r) for i, *r in rows], kind) for p in ("S1", "S2"))
    want = {}
    for x in rows:
        for y in rows:
            if (x[1] and x[1] == y[1]) or (x[2] and x[2] == y[2]):
                n = [v for v in (x[3], y[3]) if v is not None]
                s = (2_000_000 * min(n) + max(n)) // (2 * max(n)) if n and max(n) else -1
                want[f"S1-{x[0]}", f"S2-{y[0]}"] = (s, x[4] == y[4] and x[0] != y[0])
    return pairing, a, b, want


def test_blocks_give_all_pairs_once(spark, monkeypatch):
    pairing, a, b, want = _pairs_by_blocks(spark, monkeypatch)
    got = pairing.every(a, b).collect()
    assert len(got) == len(want) and {(r["s1_id"], r["target_id"]): (r["s"], r["same"]) for r in got} == want


def test_blocks_count_what_pairs_have(spark, monkeypatch):
    pairing, a, b, want = _pairs_by_blocks(spark, monkeypatch)
    got = {r["s1_id"]: tuple(r)[1:] for r in pairing.counts(a, b, [(-1, None), (900_000, None)]).collect()}
    own = {i: [v for (x, _), v in want.items() if x == i] for i, _ in want}
    assert got == {i: (len(v), sum(t for _, t in v), sum(s >= 900_000 for s, _ in v), sum(t for s, t in v if s >= 900_000)) for i, v in own.items()}
    hist = {r["s"]: (r["n"], r["positives"]) for r in pairing.histogram(a, b).collect()}
    assert hist == {s: (sum(v[0] == s for v in want.values()), sum(v[1] for v in want.values() if v[0] == s)) for s, _ in want.values()}


def test_blocks_give_the_best_and_sorted_lists(spark, monkeypatch):
    pairing, a, b, want = _pairs_by_blocks(spark, monkeypatch)
    ranked = {}
    for (x, y), (s, _) in sorted(want.items(), key=lambda kv: (-kv[1][0], kv[0][1])):
        ranked.setdefault(x, []).append((y, s))
    for k in (1, 3):
        got = decide.top(pairing.best(a, b, k).withColumn("score", F.col("s")), k).collect()
        assert {(r["s1_id"], r["target_id"]) for r in got} == {(x, y) for x, v in ranked.items() for y, _ in v[:k]}
    listed = decide.submission_of(a.select(F.col("id").alias("s1_id")), pairing.lists(a, b, 900_000)).collect()
    assert {r[0]: r[1] for r in listed} == {f"S1-{i}": ",".join(y for y, s in ranked.get(f"S1-{i}", []) if s >= 900_000) for i in range(40)}


def test_margins_and_calibration_from_counts(spark, monkeypatch):
    from kindred.operators import learn

    pairing, a, b, _ = _pairs_by_blocks(spark, monkeypatch)
    p = pairing.every(a, b).where("s >= 0").withColumns({"score": F.col("s") / 1_000_000, "label": F.col("same").cast("int")})
    truth, u = p.where("same").select("s1_id", "target_id"), a.select(F.col("id").alias("s1_id"))
    cells = [(t, m) for t in (0.8, 0.95) for m in (0.0, 0.1)]
    top = pairing.best(a, b, 1).groupBy(F.col("s1_id").alias("id")).agg(F.max("s").alias("best"))
    n = pairing.counts(a.join(top, "id"), b, [(round(t * 1e6), round(m * 1e6)) for t, m in cells])
    found = lambda x: {(r["threshold"], r["margin"]): (round(r["macro_f05"], 9), r["predicted"], r["tp"]) for r in x.collect()}
    assert found(evaluate.margin_grid_of(u, truth.groupBy("s1_id").agg(F.count("*").alias("a")), n, cells)) == found(evaluate.margin_grid(u, truth, p, [0.8, 0.95], [0.0, 0.1]))
    hist = pairing.histogram(a, b)
    x, y = ({r["bucket"]: (r["n"], r["positives"], round(r["rate"], 9), round(r["mean_score"], 9)) for r in c.collect()} for c in (evaluate.calibration(p), evaluate.calibration_of(hist.where("s >= 0"))))
    assert x == y
    plain = {(r["s1_id"], r["target_id"]): round(r["prob"], 6) for r in learn.apply_calibration(learn.calibrate(p), p).collect()}
    model = learn.calibrate_of(hist)
    assert plain == {(r["s1_id"], r["target_id"]): round(r["q"], 6) for r in p.withColumn("q", learn.calibrated(model, F.col("score"))).collect()}


def test_labelled_sample_takes_the_smallest_hashes(spark):
    import hashlib

    rows = [(f"S1-{i}", f"S2-{i}", int(i % 3 == 0)) for i in range(60)]
    got = {tuple(r) for r in evaluate.labelled_sample(spark.createDataFrame(rows, "s1_id string, target_id string, label int"), 4, 9).collect()}
    order = sorted(rows, key=lambda r: hashlib.sha256(f"{r[0]}|{r[1]}".encode()).hexdigest())
    assert got == {*[r for r in order if r[2]][:4], *[r for r in order if not r[2]][:9]}
    plan = evaluate.labelled_sample(spark.createDataFrame(rows, "s1_id string, target_id string, label int"), 4, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2


def test_siblings_of_groups_are_those_of_pairs(spark, monkeypatch):
    pairing, a, b, want = _pairs_by_blocks(spark, monkeypatch)
    number = F.substring_index("id", "-", -1).cast("int")
    a, b = (x.withColumns({"kk": F.when(number % 6 != 1, F.concat(F.lit("k"), number % 4)), "source": F.when(number % 3 == 0, "S2").otherwise("S3")}) for x in (a, b))
    t = [(r["id"], r["kk"], r["source"]) for r in b.collect()]
    of = {i: (k, s) for i, k, s in t}
    pairs = {(x, i) for x, y in want for i, k, s in t if k and k == of[y][0] and s != of[y][1]}
    got = [tuple(r) for r in pairing.siblings(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_shared_words_are_those_of_pairs(spark, monkeypatch):
    pairing, a, b, want = _pairs_by_blocks(spark, monkeypatch)
    number = F.substring_index("id", "-", -1).cast("int")
    text = F.when(number % 8 == 0, "").otherwise(F.concat(F.lit("r "), number % 4, F.lit("  r q"), number % 3))
    a, b = (x.withColumn("w", text) for x in (a, b))
    w = {r["id"]: set(r["w"].split(" ")) for r in a.unionByName(b).collect()}
    got = [tuple(r) for r in pairing.set_similarity(a, b).collect()]
    assert len(got) == len(want)
    assert all((j, o) == pytest.approx((len(w[x] & w[y]) / len(w[x] | w[y]), len(w[x] & w[y]) / min(len(w[x]), len(w[y]))), abs=6e-7) for x, y, j, o in got)
    key = {r["id"]: r["e"] for r in a.unionByName(b).collect()}
    assert sorted(map(tuple, pairing.sharing(a, b, "e", 2).collect())) == sorted((x, y) for x, y in want if key[x] and key[x] == key[y] and len(w[x] & w[y]) >= 2)


def test_values_of_scores_reach_all_pairs(spark, monkeypatch):
    pairing, a, b, want = _pairs_by_blocks(spark, monkeypatch)
    table = {s: None if s < 0 else s / 7 for s, _ in want.values()}
    got = pairing.valued(a, b, table, "v").collect()
    assert len(got) == len(want) and {(x, y): v for x, y, v in got} == {k: table[s] for k, (s, _) in want.items()}


def _alike_documents(spark, path, n=90):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("eeeaattnoishrdlué") for _ in range(r.randint(1, 9)))
    line = lambda k: " ".join(word() for _ in range(r.randint(0, k)))
    one = ["Common Name ltd", "common name, ltd", "Common name Ltd near 12b"]
    rows = [(i, f"{r.choice(one) if i % 3 else line(9)}\n{r.choice(['', '12b Road', 'rd 7 ']) if i % 4 == 0 else line(60) + ' ' + str(i % 5)}\nx", "en" if i % 5 else "fr", "abcd" if i % 2 else "abc", i) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_against_many_are_texts_one_by_one(monkeypatch):
    import random

    from kindred.operators import alike

    monkeypatch.setattr(alike, "CELLS", 200)
    r = random.Random(3)
    text = lambda *n: "".join(r.choice("eeeaattn  oishrdlu.ABéü") for _ in range(r.choice(n))).encode()
    for _ in range(150):
        a, many = text(0, 1, 2, 3, 4, 7, 15, 70, 300), [text(0, 1, 2, 3, 5, 8, 20, 60) for _ in range(r.randint(1, 30))]
        assert alike.jaro_winkler_all(a, alike.positions(many)).tolist() == [S.jaro_winkler_bytes(a, b) for b in many]


def test_canonical_features_of_blocks(spark, tmp_path):
    from kindred.operators import features

    d = _alike_documents(spark, tmp_path)
    got = catalog.queries()["s7_s9_canonical_features"](spark, d)
    assert "ArrowEvalPython" not in _plan(got)  # no call for each pair
    x = features.canonical(features.attach(catalog.pairs(spark, d), catalog.s1(spark, d), catalog.tgt(spark, d)))
    want = x.select("s1_id", "target_id", *(F.round(n, 9).alias(n) for n in features.NAMES))
    got, want = ({r[:2]: r[2:] for r in z.select(want.columns).collect()} for z in (got, want))
    assert len(got) > 1000 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in got)


def test_interactions_of_blocks(spark, tmp_path):
    from kindred.operators import features

    d = _alike_documents(spark, tmp_path)
    got = catalog.queries()["s8_interactions"](spark, d)
    assert "ArrowEvalPython" not in _plan(got)
    x = features.interactions(features.canonical(features.attach(catalog.pairs(spark, d), catalog.s1(spark, d), catalog.tgt(spark, d))))
    want = {(r["s1_id"], r["target_id"]): (r["name_addr_jw_prod"], r["name_addr_exact_prod"]) for r in x.collect()}
    got = {(r["s1_id"], r["target_id"]): (r["jw"], r["exact"]) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=6e-7) for k in got)


def test_pairs_are_compared_where_they_are_joined(spark, tmp_path, monkeypatch):
    from kindred.operators import alike

    d, name = _alike_documents(spark, tmp_path, 60), "s8_interactions"
    got = catalog.queries()[name](spark, d)
    assert "FlatMapGroupsInArrow" not in _plan(got)  # no block leaves the JVM
    monkeypatch.setattr(alike.jvm, "jaro_winkler", lambda spark: None)
    blocks = catalog.queries()[name](spark, d)  # without access to the JVM
    assert "FlatMapGroupsInArrow" in _plan(blocks) and got.dtypes == blocks.dtypes
    got, blocks = (sorted(map(tuple, z.collect())) for z in (got, blocks))
    assert len(got) > 500 and got == blocks


def test_training_sample_is_drawn_once(spark, tmp_path, monkeypatch):
    from kindred.operators import learn

    drawn, real = [], learn.downsample
    monkeypatch.setattr(learn, "downsample", lambda df: (drawn.append(df), real(df))[1])
    rows = [(f"S1-{i}", f"S2-{i}", i % 5, int(i % 3 == 0), float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, fold int, label int, x double")
    got, models = learn.out_of_fold(df, ["x"], trees=1, depth=1)
    assert len(drawn) == 1 and len(models) == 5 and got.count() == 600


def test_forensics_of_blocks(spark, tmp_path):
    from kindred.operators import features

    d = _alike_documents(spark, tmp_path)
    got = catalog.queries()["s10_forensics"](spark, d)
    assert "ArrowEvalPython" not in _plan(got)
    x = features.forensics(features.attach(catalog.pairs(spark, d), catalog.s1(spark, d), catalog.tgt(spark, d)))
    want = x.drop("s1_name", "s1_address", "s1_country", "tgt_name", "tgt_address", "tgt_country")
    assert got.columns == want.columns
    got, want = (sorted(map(tuple, z.collect())) for z in (got, want))
    assert len(got) > 1000 and got == want


def test_landmarks_across_texts():
    import pyarrow as pa

    from kindred.operators import alike

    one, two = pa.chunked_array([["by the ne", "sec", "x", ""]]), pa.chunked_array([["ar it", "tor 5", "road", ""]])
    hit = alike._across(one, True)[:, None] & alike._across(two, False) != 0
    assert hit.tolist() == [[True, False, False, False], [False, True, False, False], [False] * 4, [False] * 4]


def _named(spark, n=60):
    """Records of two countries: copies, names of common and of rare words, empty and missing names."""
    names = [f"{'the red'[: 3 + 4 * (i % 2)]} {'abcdefgh'[i % 8] * 3} {'word' + str(i // 3) if i % 5 else ''} house" for i in range(n)]
    names[7], names[11], names[13] = "", None, "the the red the red"
    rows = [(f"r{i:02}", x, "en" if i % 4 else "fr") for i, x in enumerate(names)] + [(f"c{i:02}", "the red ccc", "en") for i in range(9)] + [("z", "the", None)]
    return rows, spark.createDataFrame(rows, "entity_id string, name string, country string")


def test_word_tfidf_of_blocks_is_that_of_joined_terms(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7), monkeypatch.setattr(retrieval, "TERMS", 50)
    _, df = _named(spark)
    # records are queries and targets under one id, and are not their own neighbours
    run = lambda blocked: {(r["s1_id"], r["target_id"], r["rank"]): r["score"] for r in retrieval.tfidf_top_k(df, df, retrieval.word_ngrams(F.col("name")), 4, 0.5, blocked=blocked).collect()}
    got, want = run(True), run(False)
    assert len(got) > 100 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_word_tfidf_query_moves_no_joined_terms(spark, tmp_path):
    _alike_documents(spark, tmp_path)
    got = catalog.queries()["j24_tfidf_words"](spark, str(tmp_path))
    assert got.columns == ["s1_id", "target_id", "score", "rank"] and "FlatMapCoGroupsInArrow" in _plan(got)


def test_products_of_rare_and_common_terms(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = ((rng.random((n, 60)) < np.linspace(0.01, 0.9, 60)) * rng.random((n, 60)) for n in (23, 31))
    b[:, 9], a[:, 17] = 0, 0
    for common, cells, hits, width in ((0.01, 100, 9, 4), (2, 100, 9, 4), (-1, 10**6, 10**6, 256), (0.2, 10**6, 40, 7)):
        for name, value in (("COMMON", common), ("CELLS", cells), ("HITS", hits), ("WIDTH", width)):
            monkeypatch.setattr(retrieval, name, value)
        for ones in (False, True):
            sides = []
            for x in (a, b):
                p = retrieval._Piece.__new__(retrieval._Piece)
                p.rows, (p.row, col) = len(x), np.nonzero(x)
                p.i, p.w = col * 10**12, None if ones and x is b else x[p.row, col]
                sides.append(p)
            got = np.concatenate([d for _, d in retrieval._products(*sides)])
            assert np.allclose(got, a @ ((b > 0) if ones else b).T)


def test_token_index_of_blocks(spark, monkeypatch):
    from math import log1p

    monkeypatch.setattr(retrieval, "BLOCK", 5)
    rows, df = _named(spark)
    words = {i: {w for w in (x or "").split() if len(w) >= 3} for i, x, _ in rows}
    df_of = lambda c, w: sum(w in words[i] for i, _, o in rows if o == c)
    for same in (True, False):
        targets = df if same else df.withColumn("entity_id", F.concat(F.lit("t-"), "entity_id"))
        got = {}
        made = retrieval.token_index(df, targets, F.filter(F.split("name", " "), lambda x: F.length(x) >= 3), 6, 30)
        for r in made.collect():
            got.setdefault(r["s1_id"], {})[r["rank"]] = (r["target_id"], r["score"])
        for i, _, c in rows:
            found = []
            for j, _, d in rows:
                shared = [w for w in words[i] & words[j] if df_of(c, w) <= 30] if c and c == d and not (same and i == j) else []
                if shared:
                    found.append((-round(sum(log1p(len(rows) / df_of(c, w)) for w in shared), 4), j if same else f"t-{j}"))
            assert got.get(i, {}) == {at + 1: (j, -s) for at, (s, j) in enumerate(sorted(found)[:6])}
    plan = _plan(made)
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_folds_are_scored_from_features_of_blocks(spark, tmp_path, monkeypatch):
    from kindred.operators import features, learn
    from kindred.plans import linkage

    d, seen = _alike_documents(spark, tmp_path), []
    real = learn.out_of_fold
    monkeypatch.setattr(learn, "out_of_fold", lambda df, *a, **b: (seen.append(df), real(df, *a, **b))[1])
    got = catalog.queries()["l2_l4_out_of_fold_scores"](spark, d)
    # features are read, not made anew for every model and fold
    assert not any(x in _plan(got) for x in ("FlatMapGroupsInArrow", "Join"))
    pairs = linkage.label(catalog.pairs(spark, d), catalog.truth(spark, d)).withColumn("fold", K.fold("s1_id", 5))
    want = features.canonical(features.attach(pairs, catalog.s1(spark, d), catalog.tgt(spark, d)))
    of = lambda df: sorted(tuple(r) for r in df.select("s1_id", "target_id", "fold", "label", *(F.round(c, 9) for c in features.NAMES)).collect())
    assert of(seen[0]) == of(want)
    rows = got.collect()
    assert got.columns == ["s1_id", "target_id", "fold", "label", "score"] and len(rows) == want.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_matched_characters_are_those_of_difflib():
    import difflib
    import random

    from kindred.operators import alike

    r = random.Random(8)
    text = lambda n, of: "".join(r.choice(of) for _ in range(n))
    for of in ("ab", "abcde fgh", "eeeeeettttaaoinshrdlucmfwypvbgkjqxz0123456789 "):
        for _ in range(60):
            a, b = text(r.choice((0, 1, 7, 60, 230)), of), text(r.choice((1, 9, 199, 200, 330)), of)
            a = r.choice((a, b[5:] + a, a + b[:70], b))
            want = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
            assert alike.Sequences(b).matched(a) == want


def test_characters_of_many_texts_are_matched_at_once(monkeypatch):
    import difflib
    import random

    import numpy as np

    from kindred.operators import alike

    r = random.Random(9)
    text = lambda n, of: "".join(r.choice(of) for _ in range(n))
    numbers = lambda t: np.array([ord(c) for c in t], np.int32)
    for points in (1 << 20, 900):
        monkeypatch.setattr(alike, "POINTS", points)
        for of in ("ab", "abcde fgh", "eeeeeettttaaoinshrdlucmfwypvbgkjqxz0123456789 ", "eeeeeeeettttttttaaaaaaaoooooooxyz,.;ABCDEFGHIJKLMN"):
            for n in (1, 2, 9, 70, 199, 200, 330, 650):
                b = text(n, of)
                a = ["", *(text(k, of) for k in (1, 7, 60, 230, 500))]
                a += [b[5:] + a[3], a[3] + b[:70], a[4] + b[30:90] + a[3] + b[10:30], b[:100] + "Q" + b[101:], b]
                want = [sum(m.size for m in difflib.SequenceMatcher(None, x, b).get_matching_blocks()) for x in a]
                many = alike.Many([numbers(x) for x in a], 128)
                assert many.matched(numbers(b)).tolist() == many.matched(numbers(b), len(a) - 1).tolist() == want


def test_sequence_ratios_of_a_group_take_no_step_a_pair(monkeypatch):
    import random

    import pyarrow as pa

    from kindred.operators import alike, pairing

    r, calls = random.Random(2), []
    line = lambda: "".join(r.choice("eeeaattnoishrdlu   ,.12") for _ in range(r.choice((20, 150, 260))))
    side = lambda n: pa.table({"k": ["g"] * n, "n": [1] * n, "c": ["c"] * n, "d": [1] * n, "aa": [line() for _ in range(n)]})
    block = pairing.Block(side(40), side(30), False)
    monkeypatch.setattr(alike.Sequences, "matched", lambda self, a: calls.append(a))
    *_, li, ri, _s, _t = next(block.slices())
    got = alike._Ratios(block, "aa").of(li, ri, 4)
    a, b = (t.column("aa").to_pylist() for t in (block.left, block.right))
    assert not calls and got.tolist() == pytest.approx([S.sequence_ratio_value(a[i], b[j]) for i, j in zip(li, ri)], abs=6e-5)


def test_compact_features_of_blocks(spark, tmp_path):
    from kindred.operators import features

    d = _alike_documents(spark, tmp_path)
    got = catalog.queries()["s1_s6_compact_features"](spark, d)
    assert "ArrowEvalPython" not in _plan(got)
    want = features.compact(catalog.pairs(spark, d), catalog.s1(spark, d), catalog.tgt(spark, d))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    got, want = (sorted(map(tuple, z.collect())) for z in (got, want))
    assert len(got) > 1000 and got == want


def test_char3_multiplies_equal_names_once(spark, tmp_path, monkeypatch):
    tables, real = [], retrieval.settle
    monkeypatch.setattr(retrieval, "settle", lambda df: (tables.append(real(df)), tables[-1])[1])
    rows = [(i, f"name {'abc'[i % 3]} ltd\n{i} road", "en" if i % 4 else "fr", "abcd", 20) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["j25_tfidf_char3"](spark, str(tmp_path))
    sets = [t for t in tables if "v" in t.columns]
    assert len(sets) == 1 and sets[0].count() == 6 and got.count() == 2000 and got.where("score = 1").count() == 2000
