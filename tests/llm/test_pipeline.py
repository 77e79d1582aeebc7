import hashlib
import math
import random
import re

import corpus_pipeline
from weirstream.llm import mixing, pieces
from weirstream.llm.common import staged
from weirstream.llm.queries import default_model_file


def test_stages_on_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, ""), name)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        kept.append([r.doc_id for r in out.collect()])
        docs = out
    assert not {3, 4, 5, 8} & set(kept[0])  # nothing with letters
    assert 11 in kept[1] and not {1, 2} & set(kept[1]) and kept[1].count(12) == 1
    assert 6 in kept[2] and 14 not in kept[2]
    assert set(kept[3]) <= set(kept[2]) and sorted(kept[3], key=str) == sorted(kept[4], key=str)


def test_no_rows(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def brute_run(docs):
    """(doc_id, text, ids) of what the stages leave of (doc_id, text, source), each stage by plain Python."""
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]  # language
    by_text = {}
    for d in docs:
        by_text[d[1]] = max(by_text.get(d[1], d), d, key=lambda x: x[0])
    docs = sorted(by_text.values())
    words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = []
    for _, text, _ in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if 100 * both >= 80 * (len(shingles[i]) + len(shingles[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    sources = sorted({d[2] for d in docs}, key=lambda x: (x is None, x or ""))
    size = {s: sum(len(words(d[1])) for d in docs if d[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size.values()), list(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ = [s for s in open_ if s not in target]
    out = []
    codec = pieces.Codec(pieces.load(default_model_file()))
    for s in sources:
        at = 0
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()  # noqa: E731, S324
        for i, text, _ in sorted((d for d in docs if d[2] == s), key=lambda d: (md5(f"mix|{d[0]}"), d[0])):
            n = len(words(text))
            got = [max(0, min(n, math.floor(target[s]) - at - p * size[s])) for p in range(3)]
            out += [(i, text, tuple(codec.encode(text)))] * min(sum(g > 0 for g in got), math.floor(sum(got) / n + 0.5))
            at += n
    return sorted(out)


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    habits = {"en": "the cat sat there with thin things and then this hat was the thing", "de": "der hund und die katze sind nicht in der nacht durch das haus"}
    docs = []
    for i in range(90):
        lang = rng.choice(list(habits))
        text = " ".join(rng.choice(habits[lang].split()) + rng.choice(["", str(rng.randrange(40))]) for _ in range(rng.randrange(1, 60)))
        docs.append((i, text, lang if i % 7 else None, f"s{i % 4}" if i % 11 else None))
    docs += [(100 + i, docs[i][1], docs[i][2], "s1") for i in range(0, 20, 2)]  # copies
    docs += [(200 + i, docs[i][1] + " tail", docs[i][2], "s2") for i in range(1, 60, 3)]  # near copies, of long texts
    docs += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, "12 !?", "de", None), (303, "ÄÖ über", "de", "s3")]
    frame = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.text, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute_run([(i, t, s) for i, t, _, s in docs])
    assert got == want and len({i for i, *_ in want}) < 100


def test_a_source_of_many_parts_is_put_in_the_same_order(spark):
    """From 128 parts of a source on, a document's place times their number is above 2^31."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of ', id) AS text", "if(id % 9 = 0, 's1', 's0') AS source")
    few, many = (mixing.training_order(docs, mixing.Curriculum(rows_per_part=n)).collect() for n in (2_000, 1))
    assert few == many and len(many) > 500
