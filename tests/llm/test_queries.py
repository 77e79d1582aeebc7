"""The registered queries, run whole on a small table, against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirstream.llm import langid, queries, shards

HABITS = {"en": "the cat sat there with thin things and then this hat was the thing", "de": "der hund und die katze sind nicht in der nacht durch das haus", "fi": "kissa ja koira menivät yöllä metsään eivätkä he tulleet takaisin"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(7)
    docs = []
    for i in range(160):
        lang = rng.choice(list(HABITS))
        words = HABITS[lang].split()
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))), None if i % 9 == 0 else lang, f"s{i % 4}"))
    docs += [(160, None, "en", "s1"), (161, "", None, None), (162, "12 !?", "de", "s0"), (163, "ÄÖ über", "de", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['a.', 'www.', ''])}{rng.choice(['Example', 'other', 'xexample'])}.{rng.choice(['com', 'net', 'org', 'io'])}{rng.choice(['/en/', '/de/', '/es/', '/'])}{rng.randrange(90)}{rng.choice(['', '?q=/en/1', '#top'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "x://", "a://b://example.com/en/7", "http://com/en/1", "http://com?/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return str(path), docs, urls


def test_language_id_query(spark, folder):
    """Profiles, ranks and distances from counted strings."""
    path, docs, _ = folder
    grams = lambda text: Counter(g for w in langid.words_of(text) for g in langid.grams_of(w, 5))
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in docs}
    counts = {}
    for i, text, lang, _ in docs:
        if text is not None and lang is not None and not held[i]:
            counts.setdefault(lang, Counter()).update(grams(text))
    ranks = {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400])} for lang, c in sorted(counts.items())}

    def judge(text):
        found = grams(text or "")
        if not found:
            return "und"
        ordered = sorted(found.values(), reverse=True)
        if len(ordered) > 400:
            found = {g: n for g, n in found.items() if n >= ordered[399]}
            ordered = sorted(found.values(), reverse=True)
        place = {n: (ordered.index(n) + len(ordered) - 1 - ordered[::-1].index(n)) / 2 for n in set(ordered)}
        far = {lang: sum(min(abs(r[g] - min(place[n], 400)), 400) if g in r else 400 for g, n in found.items()) for lang, r in ranks.items()}
        return min(far, key=lambda x: (far[x], x))

    rows = {r.doc_id: r for r in queries.op4_language_id(spark, path).collect()}
    assert len(rows) == len(docs)
    for i, text, *_ in docs:
        assert (rows[i].held_out, rows[i].lang_pred) == (held[i], judge(text)) and 0 <= rows[i].score <= 1


def test_language_id_query_without_languages(spark, tmp_path):
    spark.createDataFrame([(1, "a text", None), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.lang_pred, r.score) for r in queries.op4_language_id(spark, str(tmp_path)).collect()] == [("und", 0.0)] * 2


def test_url_filter_query(spark, folder):
    path, _, urls = folder

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    rows = {r.page_id: r for r in queries.op9_url_filter(spark, path).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        host, p = parts(url)
        fits = [r for r in queries.URL_RULES if (host == (name := r.pattern.split("/")[0]) or host.endswith("." + name)) and p.startswith(r.pattern[len(name) :])]
        best = max(fits, key=lambda r: len(r.pattern), default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, p, best and best.pattern), url
        assert rows[i].verdict == best.verdict if best else rows[i].verdict in ("allow", "block")


def test_sharding_query(spark, folder):
    """One bucket holds all of this table, so the whole order is one shuffle of the rows in hash order."""
    path, docs, _ = folder
    hashed = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", F.xxhash64(F.lit(20240601), "doc_id", "text").alias("h")).collect()
    inside = [r.doc_id for r in sorted(hashed, key=lambda r: (r.h, r.doc_id))]
    order = [inside[i] for i in shards.fisher_yates(len(inside), 20240601, 0)]
    base, extra = divmod(len(docs), 16)
    want = [(s, slot) for s in range(16) for slot in range(base + (s < extra))]
    text = {d[0]: (d[1] or "").encode() for d in docs}
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in queries.op10_sharding(spark, path).collect()}
    assert got == {d: (len(text[d]) + 1, zlib.crc32(text[d]), "rows", *want[at], None) for at, d in enumerate(order)}


def test_sentencepiece_query(spark, folder):
    """Every text segmented character by character over the model's own pieces; of equal paths the one whose last piece is longer."""
    import math

    import numpy as np
    import sentencepiece

    path, docs, _ = folder
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.default_model_file())
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    score = {sp.id_to_piece(i): (float(np.float32(-math.log(rank + 10))), i) for rank, i in enumerate(ranked)}
    least, longest = min(s for s, _ in score.values()) - 10, max(map(len, score))
    byte = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if sp.is_byte(i)}

    def segmented(text):
        text = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0, [])] + [(-math.inf, 0, [])] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                found = score.get(text[start:end])
                if found and best[start][0] + found[0] > best[end][0]:
                    best[end] = (best[start][0] + found[0], start, [found[1]])
            if text[end - 1] not in score and best[end - 1][0] + least > best[end][0]:
                best[end] = (best[end - 1][0] + least, end - 1, [byte[f"<0x{b:02X}>"] for b in text[end - 1].encode()])
        ids, at = [], len(text)
        while at:
            ids = best[at][2] + ids
            at = best[at][1]
        return ids

    rows = {r.doc_id: r for r in queries.op3_sentencepiece(spark, path).collect()}
    assert len(rows) == len(docs)
    for i, text, *_ in docs:
        want = segmented(text) if text else []
        assert (rows[i].ids or []) == want and rows[i].n_tokens == len(want) and rows[i].round_trip
        assert rows[i].n_byte_tokens == sum(x in byte.values() for x in want)
