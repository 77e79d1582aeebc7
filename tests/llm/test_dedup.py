import hashlib
import random
from collections import defaultdict

from weirstream.llm import components, digest_index, neardup


def test_exact_dedup_odd_rows(odd_docs):
    rows = digest_index.exact_dedup(odd_docs).collect()
    docs = odd_docs.collect()
    assert len(rows) == len(docs)
    groups = defaultdict(list)
    for d in docs:
        groups[hashlib.sha256((d.text or "").encode()).digest()].append(d.doc_id)
    seen = defaultdict(int)
    for r in rows:
        ids = groups[bytes(r.digest)]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        seen[bytes(r.digest)] += r.kept
        assert not r.kept or r.doc_id == best
    assert set(seen.values()) == {1} and len(seen) == len(groups)


def test_exact_dedup_empty(no_docs):
    assert digest_index.exact_dedup(no_docs).count() == 0
    assert digest_index.drop_copies(no_docs).count() == 0


def test_index_knows_earlier_batches(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "b"), (5, "c"), (6, "c")], "doc_id long, text string")
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert sorted(r.doc_id for r in digest_index.exact_dedup(one, index).collect() if r.kept) == [2, 3]
    index.drop()
    again = digest_index.DigestIndex(spark, str(tmp_path / "index"), 4)  # another session finds the files
    got = {r.doc_id: (r.kept, r.seen_before, r.keep_id) for r in digest_index.exact_dedup(two, again).collect()}
    assert got == {4: (False, True, 2), 5: (False, False, 6), 6: (True, False, 6)}
    assert again.read().count() == 3
    again.drop()


def test_index_is_read_by_its_buckets(spark, tmp_path):
    """A batch is shuffled into the buckets of the index; the index itself stays where it is, and no table is left behind."""
    rows = spark.range(100).selectExpr("id AS doc_id", "concat('t', id % 60) AS text")
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), 8)
    assert digest_index.exact_dedup(rows, index).filter("kept").count() == 60
    plan = index.lacking(digest_index.with_digest(rows).select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.index("FileScan")
    index.drop()
    before = len(spark.catalog.listTables())
    assert digest_index.exact_dedup(rows).filter("kept").count() == 60 and len(spark.catalog.listTables()) == before


def test_drop_copies_keeps_columns_and_one_row(odd_docs):
    out = digest_index.drop_copies(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == odd_docs.selectExpr("coalesce(text, '') t").distinct().count()


def brute_components(docs, plan):
    """By definition: all pairs of sets of strings."""
    sets = []
    for _, text in docs:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        n = plan.words
        sets.append({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w) + "|short"} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= plan.similarity * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda x: docs[x][0])
                parent[b] = a
    return {docs[i][0]: (len(sets[i]), docs[root(i)][0]) for i in range(len(docs))}


def variants(rng, n_groups, per_group, n_words):
    docs = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(400)}" for _ in range(n_words)]
        for _ in range(per_group):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + n_words // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    return docs


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    plan = neardup.NearDup(words=4, block=3)  # so small that groups are dealt over several tasks
    docs = variants(rng, 6, 14, 120) + [(1000 + i, t) for i, t in enumerate(["", None, "a", "a", "A b", "a b c", " "])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, plan).collect()}
    assert got == brute_components(docs, plan)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.component_id, r.kept))
    assert by_id[2] == {(1, False)} and by_id[11] == {(1, False)} and by_id[3] == {(3, True)} and by_id[14] == {(6, False)}
    assert by_id[None] == {(None, True)} and by_id[12] == {(12, True)}
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
