import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weirstream.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """The root, and for each node its siblings with whether they come after it."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, n in enumerate(at):
            if n ^ 1 < len(nodes):
                proofs[i].append((nodes[n ^ 1], n % 2 == 0))
            else:
                proofs[i].append((None, True))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [n // 2 for n in at]
    return nodes[0], proofs


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def brute(docs):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, source, lang, n_chars, text)."""
    langs, found = {}, []
    for d in docs:
        langs.setdefault(d[2], []).append(d)
    ordered = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in ordered:
        langs[lang].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[lang] = tree([leaf(d) for d in langs[lang]])
    root, above = tree([trees[x][0] for x in ordered]) if ordered else (None, [])
    for lang, top in zip(ordered, above, strict=True):
        for d, own in zip(langs[lang], trees[lang][1], strict=True):
            proof = own + top
            tampered = d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            value = leaf((*d[:3], d[3] + 1, d[4])) if tampered else leaf(d)
            for s, after in proof:
                value = sha(value if s is None else value + s if after else s + value)
            found.append((d[0], leaf(d), trees[lang][0], root, sha("".join(s for s, _ in proof if s)), value, value == root))
    return sorted(found, key=str)


def table(spark, docs, path):
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("levels, n_langs", [(10, 3), (2, 40)])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, levels, n_langs):
    """With two levels a task, trees take several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(n_langs)
    docs = [(i * 3, f"s{i % 4}", rng.choice([f"l{rng.randrange(n_langs)}", "en"]), None if i % 9 == 0 else i, f"text {i} ü" * rng.randrange(3)) for i in range(260)]
    docs += [(1, None, None, 5, None), (None, "s", "en", 3, "no id"), (None, "s", "en", 3, "no id"), (3, "s", "en", 1, "same id"), (3, "s", "en", 1, "same id"), (10**12, "", "", 0, ""), (-7, "s", "日本", -3, "x")]
    table(spark, docs, tmp_path)
    got = sorted(map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(docs)
    assert {r[6] for r in got} == {True, False} and all(r[5] == r[3] for r in got if r[6])


@pytest.mark.parametrize("docs", [[], [(5, "s", "en", 1, "one")], [(i, "s", f"l{i}", 1, "each alone") for i in range(5)]], ids=["none", "one", "lone"])
def test_small_tables(spark, tmp_path, docs):
    table(spark, docs, tmp_path)
    assert sorted(map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect()), key=str) == brute(docs)


def test_parents_take_nodes_in_any_order():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 64, 65):
        leaves = [sha(str(i)) for i in range(n)]
        events = list(enumerate(leaves))
        rng.shuffle(events)
        parts = [merkle.Parents(99) for _ in range(3)]
        frontier = [done for i, d in events if (done := parts[i % 3].add("t", 0, i, d, n))]  # three tasks
        frontier += [x[1:] for p in parts for x in p.left()]
        rng.shuffle(frontier)
        last = merkle.Parents(99)
        done = [x for level, i, d in frontier if (x := last.add("t", level, i, d, n))]
        assert [x[2] for x in done] == [tree(leaves)[0]] and not list(last.left())


def test_a_changed_leaf_does_not_verify(spark):
    docs = spark.createDataFrame([(i, "x" * i, "en") for i in range(20)], "doc_id long, text string, lang string").withColumn("leaf", F.lit("a clashing column"))
    rows = merkle.manifest(docs, merkle.leaf_of(F.col("doc_id"), F.col("text")), claimed=F.when(F.col("doc_id") == 4, F.lit("0" * 64)))
    rows = rows.withColumn("ok", merkle.folded(F.col("claimed"), F.col("proof")) == F.col("root")).collect()
    assert sorted(r.doc_id for r in rows if not r.ok) == [4]
    assert all(len(r.proof) == 5 and all(step.place in (0, 1) for step in r.proof) for r in rows)
