import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from weirstream.llm import boosting, mixing, queries, shards, topk, url_filter


def brute_top(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 50 == 0:
            scored = sorted((-int(np.dot(v, w)), i) for i, w in vectors.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-300, 300, 24) * (1 + 5 * (i % 17 == 0)) for i in range(600)}
    vectors |= {i: vectors[7] for i in range(600, 640)} | {900: np.zeros(24, int)}
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in vectors.items()], "vec_id long, v array<long>, rank string")
    got = defaultdict(list)
    for r in topk.search(frame, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == brute_top(vectors, 5)


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, float("nan")]), (1, None), (2, [None, 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, -1.0]), (None, [1.0, 1.0]), (4, [1.0, -1.0]), (5, [2.0]), (6, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(frame, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 256 * 512), (0, 2, 6, 0), (0, 3, 4, 256 * 256 - 512 * 256), (0, 4, 4, 256 * 256 - 512 * 256)]
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_repeated_ids_are_rows(spark):
    """Every row but the query's own is a candidate, also one with the query's id; each query row has its answers."""
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-9, 9, 4).tolist()) for i in rng.integers(40, 60, 300)] + [(50, [9, 9, 9, 9])] * 3 + [(7, [9, 9, 9, 8])] * 9
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-int(np.dot(v, w)), i) for other, (i, w) in enumerate(rows) if other != at)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert sorted(map(tuple, topk.search(frame, F.col("vec_id") % 50 == 0, 5).collect())) == sorted(want)


def test_topk_bands_prune(spark):
    """Lengths that fall off: bands of short vectors are still searched for queries without k answers, and give none to the others."""
    rng = np.random.default_rng(4)
    vectors = {i: (rng.integers(-500, 500, 8) // (1 + i % 40)) for i in range(500)}
    vectors |= {500: np.array([1, 0, 0, 0, 0, 0, 0, 0]), 550: np.zeros(8, int)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, v array<long>")
    got = defaultdict(list)
    old, topk.SEEDS = topk.SEEDS, 3
    try:
        for r in topk.search(frame, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        topk.SEEDS = old
    assert got == brute_top(vectors, 5)


def test_mix_meets_targets(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), None if i % 10 == 0 else f"s{min(i % 9, 3)}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, mixing.Curriculum(rows_per_part=20)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 2 * r.size and all(0 <= t <= 1 for t in r.positions)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 1 for s in target) and all(target[s] <= 2 * sizes[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    weights = {s: w for s, w in zip(sorted(s for s in sizes if s) + [None], [3, 1, 2] * 2, strict=False)}
    level = {target[s] / weights[s] for s in target if target[s] < 2 * sizes[s] - 1e-6}
    assert max(level) - min(level) < 1e-6
    again = mixing.mix(frame.repartition(7), mixing.Curriculum(rows_per_part=20)).collect()
    assert sorted((r.doc_id, r.taken, tuple(r.positions)) for r in got) == sorted((r.doc_id, r.taken, tuple(r.positions)) for r in again)
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, "a"), (3, "w w", "b"), (4, "w", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.target, r.taken, r.positions) for r in mixing.mix(blank).filter("source = 'a'").collect()} == {1: (0.0, 0, []), 2: (0.0, 0, [])}
    assert mixing.mix(blank.filter("source = 'a'")).select("positions").collect() and mixing.training_order(blank).count() > 0
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert mixing.training_order(odd_docs).columns == odd_docs.columns and mixing.training_order(no_docs).count() == 0


def test_positions_invert_demand(spark):
    for tilt in (0.5, -0.5, 0.0):
        rows = spark.createDataFrame([(float(x),) for x in range(0, 101, 10)], "d double")
        for r in rows.select("d", mixing.position(F.col("d"), F.lit(100.0), F.lit(tilt)).alias("t")).collect():
            assert abs(100 * ((1 + tilt) * r.t - tilt * r.t * r.t) - r.d) < 1e-6


def test_shuffle_matches_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, "y" * rng.randrange(0, 50)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"n_shards": 7, "bucket_bytes": 3000, "seed": 5}
    got = shards.external_shuffle(frame, **options).collect()
    total = sum(len(t) + 32 for _, t in rows)
    n_buckets = -(-total // 3000)
    hashed = frame.select("doc_id", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("h")).collect()
    order = []
    for b in range(n_buckets):
        inside = sorted((r.h, r.doc_id, r.text) for r in hashed if r.h % n_buckets == b)
        order += [inside[i][1] for i in shards.fisher_yates(len(inside), 5, b)]
    base, extra = divmod(1000, 7)
    want, at = {}, 0
    for s in range(7):
        for slot in range(base + (s < extra)):
            want[order[at]] = (s, slot)
            at += 1
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    again = shards.external_shuffle(frame.repartition(5), **options).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    odd = shards.external_shuffle(odd_docs, 4).collect()
    assert sorted((r.shard, r.slot) for r in odd) == [(s, i) for s in range(4) for i in range(5 if s < 2 else 4)]
    assert shards.external_shuffle(no_docs).count() == 0


def test_shards_are_written(spark, tmp_path):
    frame = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    shards.write_shards(frame, str(tmp_path / "out"), n_shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def test_url_rules(spark):
    cases = {
        "https://a.example.com/en/8": ("com/en/", "block"), "https://example.com/en/71?x": ("example.com/en/7", "allow"), "HTTP://WWW.EXAMPLE.COM/en/7": ("example.com/en/7", "allow"),
        "http://x.net/de/8": ("net/de/", "allow"), "http://q.example.net/de/81#t": ("example.net/de/8", "block"), "http://x.org/es/": ("org/es/", "block"), "http://xcom/en/": (None, None), "no scheme": (None, None), None: (None, None), "://": (None, None),
    }
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id int, url string, score string")
    rows = {r.url: r for r in url_filter.judge(frame, queries.URL_RULES).collect()}
    for u, (rule, verdict) in cases.items():
        assert rows[u].rule == rule and rows[u].verdict in ("allow", "block") and (verdict is None or rows[u].verdict == verdict)
    assert (rows["HTTP://WWW.EXAMPLE.COM/en/7"].host, rows["HTTP://WWW.EXAMPLE.COM/en/7"].path) == ("www.example.com", "/en/7")
    assert (rows["no scheme"].host, rows["no scheme"].path) == ("", "")
    assert [r.verdict for r in url_filter.judge(frame.filter("url = 'no scheme'"), queries.URL_RULES).collect()] == ["allow"]
    assert url_filter.judge(frame.limit(0), queries.URL_RULES).count() == 0


def test_url_trees_learn_what_rules_say(spark):
    """Rules hidden from the fit for part of the URLs are found again by the trees."""
    rng = random.Random(8)
    urls = [f"https://{rng.choice(['spam', 'news', 'blog'])}{rng.randrange(9)}.ex.{rng.choice(['com', 'net'])}/{rng.choice(['buy', 'read'])}/{rng.randrange(999)}" for _ in range(900)]
    truth = {u: ".com/buy/" in u for u in urls}
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = [url_filter.Rule("block", f"spam{i}.ex.com/buy/") for i in range(9)] + [url_filter.Rule("block", f"news{i}.ex.com/buy/") for i in range(9)]
    rules += [url_filter.Rule("allow", f"{s}{i}.ex.{t}/") for i in range(9) for s in ("spam", "news") for t in ("com", "net")]
    rows = url_filter.judge(frame, rules, rounds=4).filter("rule IS NULL").collect()
    assert len(rows) > 200 and sum((r.verdict == "block") == truth[r.url] for r in rows) / len(rows) > 0.9


def test_trees_as_columns_score_as_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(4)
    rows = [(rng.random(), rng.random(), 0.0) for _ in range(400)]
    rows = [(a, b, float(a + b * b > 0.8)) for a, b, _ in rows]
    frame = spark.createDataFrame(rows, "a double, b double, y double")
    ours = boosting.fit(frame, ["a", "b"], "y", rounds=4, depth=3)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(frame)
    theirs = GBTClassifier(featuresCol="f", labelCol="y", maxIter=4, maxDepth=3, seed=7, stepSize=0.3, maxBins=32).fit(data)
    got = [r.p for r in frame.select(ours.probability(F.col).alias("p")).collect()]
    want = [r.probability[1] for r in theirs.transform(data).collect()]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_url_shares_count_all_labelled_urls(spark):
    alike = "q" * 40
    urls = [(f"http://site{i % 60}.ex.com/{alike}{'bad' if i % 2 else 'good'}/{i}") for i in range(3000)]
    urls += [f"http://new.ex.net/{alike}{'bad' if i % 2 else 'good'}/x{i}" for i in range(40)]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = [url_filter.Rule("block", f"ex.com/{alike}bad/"), url_filter.Rule("allow", f"ex.com/{alike}good/")]
    with_path = frame.withColumn("host", url_filter.host_and_path(F.col("url"))[0]).withColumn("path", url_filter.host_and_path(F.col("url"))[1])
    ruled = with_path.withColumn("__fold", url_filter._fold(F.col("url"))).withColumn("__ruled", F.when(F.col("host").endswith(".net"), F.lit(None)).when(F.col("path").contains("bad/"), F.lit("block")).otherwise(F.lit("allow")))
    counted = url_filter._counted(ruled)
    shares = {(r["kind"], r["value"]): r["share"] for r in counted.collect()}
    assert shares["second", "ex.com"] == 1501 / 3002 and ("second", "ex.net") not in shares
    assert shares["first_part", f"{alike}bad"] == 1501 / 1502 and shares["first_part", f"{alike}good"] == 1 / 1502
    want = [(r["url"], shares.get(("second", "ex." + r["host"][-3:]), 0.5), shares["first_part", r["path"].split("/")[1]]) for r in ruled.collect()]
    for small in (True, False):  # False joins cold values and spreads hot ones
        got = url_filter._with_shares(ruled, counted, small).select("url", "__share_second", "__share_first_part").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    labels = [(r["host"].split(".", 1)[1], r["__fold"], r["__ruled"] == "block") for r in ruled.filter("__ruled IS NOT NULL").collect()]
    for row in url_filter._with_shares(ruled.filter("__ruled IS NOT NULL"), counted, True, fitting=True).select("__fold", "__share_second").distinct().collect():
        others = [b for s, f, b in labels if s == "ex.com" and f != row["__fold"]]
        assert abs(row["__share_second"] - (sum(others) + 1) / (len(others) + 2)) < 1e-12
    few = {r["url"]: r["verdict"] for r in url_filter.judge(frame, rules, max_train=200, rounds=2).filter("rule IS NULL").collect()}
    assert len(few) == 40 and all((v == "block") == ("bad/" in u) for u, v in few.items())
    assert url_filter.judge(frame, rules, max_train=200, rounds=2, max_broadcast=0).count() == len(urls)


def test_mix_comes_from_its_sequence(spark, odd_docs, no_docs):
    """op2's rows are what the range-sorted passes add up to."""
    rows = mixing.sequence(odd_docs, mixing.Curriculum(rows_per_part=20))
    files = rows.selectExpr("_metadata.file_name AS f", "position").groupBy("f").agg(F.min("position").alias("a"), F.max("position").alias("z")).filter("a IS NOT NULL").orderBy("a", "z").collect()
    assert all(x.z <= y.a for x, y in zip(files, files[1:]))
    by_row = rows.groupBy("rank", "part", "nth").agg(F.first("doc_id").alias("d"), F.sum("words").alias("w"), F.sort_array(F.collect_list("position")).alias("p")).collect()
    mixed = mixing.mix(odd_docs, mixing.Curriculum(rows_per_part=20)).collect()
    assert sorted((str(r.d), r.w, r.p) for r in by_row) == sorted((str(r.doc_id), r.taken, sorted(r.positions)) for r in mixed)
    assert mixing.sequence(no_docs).count() == 0


def test_op2_sorts_by_position(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(mixing, "staged", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), df)[1])
    queries.op2_mixing(spark, sf_dir)
    plan = dict(plans)["sequence"]
    assert "RepartitionByExpression [position" in plan and "Sort [position" in plan


def test_mix_of_a_source_of_many_parts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words of ', id) AS text", "if(id % 9 = 0, 's1', 's0') AS source")
    few, many = ({r.doc_id: (r.target, r.taken, r.positions) for r in mixing.mix(docs, mixing.Curriculum(rows_per_part=n)).collect()} for n in (2_000, 3))
    assert few == many
    passes = mixing.sequence(docs, mixing.Curriculum(rows_per_part=3))
    taken = {r.doc_id: r.words for r in passes.groupBy("doc_id").agg(F.sum("words").alias("words")).collect()}
    assert taken == {i: t for i, (_, t, _) in few.items()}


def test_topk_bounds_the_copies_of_queries(spark, monkeypatch):
    """Many slots make small blocks of queries, with the same answers."""
    rng = np.random.default_rng(5)
    vectors = {i * 10: rng.integers(-30_000, 30_000, 16) * (1 + 7_000 * (i % 9 == 0)) for i in range(400)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, v array<long>")
    sizes, blocks = [], topk._blocks
    monkeypatch.setattr(topk, "_blocks", lambda rows, width, size: (sizes.append(size), blocks(rows, width, size))[1])
    monkeypatch.setattr(topk, "n_salts", lambda spark: 600)
    monkeypatch.setattr(topk, "SPREAD_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1 << 13, raising=False)
    got = defaultdict(list)
    for r in topk.search(frame, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == brute_top(vectors, 5)
    assert set(sizes[1::2]) == {64} and all(size * 8 * 8 * 16 <= 1 << 14 for size in sizes[::2])  # 8 slots at least of 4 cores
    assert topk.n_slots(615_384, 12_308, 600, 6) == 24 and topk.n_slots(1 << 30, 1 << 20, 600, 6) == 4096 and topk.n_slots(0, 0, 8, 4) == 8


def test_topk_packs_whole_numbers():
    for top in (0, 127, 128, -128, -129, 32_767, -32_769, 1 << 31, (1 << 63) - 1, -(1 << 63)):
        matrix = np.array([[top, 1, -1], [0, 5, top]], np.int64)
        packed = topk._packed(matrix)
        assert (topk._unpacked(packed, 3) == matrix).all() and len(packed) == 1 + 6 * (1 if -128 <= top <= 127 else 2 if abs(top) < 32_768 else 4 if abs(top) < 1 << 31 else 8)
