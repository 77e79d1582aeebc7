import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weirstream.llm import langid, pieces, pii
from weirstream.llm.queries import default_model_file


def test_language_profiles(spark, odd_docs, no_docs):
    en = ["the cat sat on the mat and then it went there", "this is the thing that they think of when they think"]
    de = ["der hund und die katze sind nicht hier gewesen", "ich bin nicht sicher dass das ein hund war"]
    frame = spark.createDataFrame([(t, "en") for t in en] + [(t, "de") for t in de] + [(None, "en"), ("nothing", None)], "text string, lang string")
    profiles = langid.learn(frame)
    assert profiles.langs == ("de", "en")
    cases = spark.createDataFrame([("they sat there", "x"), ("nicht der hund", "x"), (None, "x"), ("", "x"), ("123 !?", "x")], "text string, score string")
    got = [(r.lang_pred, r.score) for r in langid.predict(cases, profiles).collect()]
    assert [g[0] for g in got] == ["en", "de", "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got) and got[2][1] == 0
    assert langid.predict(odd_docs, profiles).count() == odd_docs.count()
    assert langid.predict(no_docs, langid.learn(no_docs)).count() == 0
    assert langid.predict(cases, langid.learn(no_docs)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_held_out_accuracy(spark):
    from weirstream.llm.queries import op4_language_id

    rows = op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = rows.filter("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 150 and right / n > 0.97


def test_gram_hashes_are_those_of_words():
    text = "L'été—fin Ⅷ a x1y  ß"
    want = sorted(langid.Ranker._whole(g) for w in langid.words_of(text) for g in langid.grams_of(w, 5))
    assert sorted(int(x) for x in langid._gram_hashes(text, 5)) == want


def brute_best(v, text):
    """The best sum of scores over all segmentations, from the end."""
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    score = {p: x for p, x in zip(v.pieces, v.scores, strict=True) if x > -math.inf}
    unknown = min(score.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0] * (len(s) + 1)
    for i in range(len(s) - 1, -1, -1):
        options = [score[s[i:j]] + best[j] for j in range(i + 1, min(len(s), i + 24) + 1) if s[i:j] in score]
        best[i] = max(options + ([] if s[i] in score else [unknown + best[i + 1]]))
    return best[0]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(default_model_file())


def total(v, ids):
    floor = min(x for x in v.scores if x > -math.inf) - pieces.UNKNOWN_PENALTY
    out, spelled = 0.0, b""
    for i in ids:
        if i in v.byte_ids:
            spelled += bytes([v.byte_ids.index(i)])
            try:
                spelled.decode()
            except UnicodeDecodeError:
                continue
            out, spelled = out + floor, b""
        else:
            out += v.scores[i]
    return out


CASES = ["Hello world", "", " ", "  two  blanks ", "tab\tline\nend", "日本語 text", "😀 emoji é", "a" * 300, "x" * 50 + " " + "y" * 50, "▁odd mark", "\x00", "### %%% &&&", "naïve café"]


def test_encoding_is_the_best_path(vocabulary):
    c = pieces.Codec(vocabulary)
    rng = random.Random(0)
    texts = CASES + ["".join(rng.choice("abet hin\n.é😀") for _ in range(rng.randrange(1, 60))) for _ in range(100)]
    for t in texts:
        ids = c.encode(t)
        assert math.isclose(total(vocabulary, ids), brute_best(vocabulary, t) if t else 0.0, abs_tol=1e-6)
        assert c.decode(ids) == t.replace(pieces.MARK, " ") or t == "▁odd mark"
        assert [i for k in c.split(t) for i in c._segment(k)] == (ids if t else c.encode("") or [i for k in c.split(t) for i in c._segment(k)])


def test_encoding_agrees_with_the_library(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(default_model_file(), "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if vocabulary.scores[i] > -math.inf:
            p.score = vocabulary.scores[i]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    c = pieces.Codec(vocabulary)
    for t in CASES:
        ids = library.encode(t)
        assert math.isclose(total(vocabulary, ids), total(vocabulary, c.encode(t)), abs_tol=1e-3)
        assert library.decode(c.encode(t)) == c.decode(c.encode(t))


def test_encoding_odd_rows(vocabulary, odd_docs, no_docs):
    rows = pieces.decoded(pieces.encoded(odd_docs, vocabulary), vocabulary).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.decoded == r.text for r in rows) and any(r.ids is None for r in rows) and any(r.ids == [] for r in rows)
    assert pieces.encoded(no_docs, vocabulary).count() == 0


def test_double_array_finds_what_it_holds():
    rng = random.Random(5)
    keys = sorted({bytes(rng.choice(b"abcxyz\xff\x00") for _ in range(rng.randrange(1, 7))) for _ in range(500)})
    trie = pieces.DoubleArray(keys)

    def find(key):
        node = 0
        for b in key:
            nxt = trie.base[node] + b
            if nxt == 0 or trie.check[nxt] != node:
                return -1
            node = nxt
        return trie.value[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"q") == -1 for k in keys)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0

    def good(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text) if good(k, m[0])]


TRICKY = [
    "a@b.c@d.e x@y.z-foo_bar@q.rs ..@a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112 5", "+1 (555) 123-4567 +123 +1234567890123456 ++49 30 1234567 x",
    "😀 jo@ex.example.com 😀 10.0.0.1", "7" * 9000, "x" * 50000 + "@", "+" + "1(" * 500, None, "", "a@b.c" * 30, "+1 2 3 4 5 6 7 8\n9",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(9)
    texts = TRICKY + ["".join(rng.choice("a1.@+- (5)4\n") for _ in range(80)) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    model = pii.PiiModel(None, ())
    got = {r.id: [(x.kind, x.s, x.e) for x in r.base] for r in pii.find(frame, model).select("id", pii.in_order(F.col("base")).alias("base")).collect()}
    for i, t in enumerate(texts):
        order = lambda x: (pii.KINDS.index(x[0]), x[1])
        assert got[i] == sorted(plain_spans(t or ""), key=order), t and t[:60]


@pytest.fixture(scope="module")
def pii_model(spark):
    assert pii.fit(spark) is pii.fit(spark)  # fitted once a session
    return pii.fit(spark)


def added(spark, model, texts):
    rows = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), model).orderBy("id").collect()
    return [[(x.kind, r.text[x.s : x.e]) for x in r.added] for r in rows]


def test_trees_add_what_base_patterns_lack(spark, pii_model, odd_docs, no_docs):
    cases = {
        "please call (555) 123-4567 now": [("phone", "(555) 123-4567")],
        "call 0049 30 1234567 today": [("phone", "0049 30 1234567")],
        "card 4111 1111 1111 1112 declined": [("card", "4111 1111 1111 1112")],
        'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here': [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")],
        "mail jo (at) ex.com soon": [("email", "jo (at) ex.com")],
        "host 192[.]168[.]1[.]20 is down": [("ip", "192[.]168[.]1[.]20")],
        "server fe80::1ff:fe23:4567:890a up": [("ip", "fe80::1ff:fe23:4567:890a")],
        # what only looks alike
        "order number 123456789 of today": [], "the number 9807915762804490 in a text": [], "on 2023-05-17 and again": [], "tracking no. 9400110200881234 was sent": [], "transaction id 1234567890123456 ok": [],
        "score 555 123 4567 points": [], "see 1920x1080x32bit_framebuffer there": [], "id 550e8400-e29b-41d4-a716-446655440000 x": [], "at 12:30:45 we left": [], "https://x.yz/p/abcdefghij1234567890/q.html": [],
    }
    assert dict(zip(cases, added(spark, pii_model, list(cases)), strict=True)) == cases
    frame = spark.createDataFrame([("please call (555) 123-4567 now",)], "text string")
    assert pii.redacted(frame, pii_model).first().text == "please call <phone> now"
    assert pii.find(odd_docs, pii_model).count() == odd_docs.count() and pii.find(no_docs, pii_model).count() == 0


def test_quality_on_templates_that_were_held_out(spark, pii_model):
    """Plants of another seed, from templates and cues that the trees haven't seen."""
    rows = {r.kind: r for r in pii.quality(spark, pii_model, 3000).collect()}
    assert set(rows) == set(pii.ALL_KINDS)
    total = lambda name: sum(r[name] for r in rows.values())
    assert total("found") / total("right") >= 0.9 and total("good") / total("accepted") >= 0.9


def test_added_spans_do_not_overlap(spark, pii_model):
    texts = ["call (555) 123-4567 890 12 34", "card 4111 1111 1111 1112 2222 3333", "token = 550e8400-e29b-41d4-a716-446655440000", "mail jo at ex dot com at ex dot org", "host fe80::1:2:3:4:5 6:7:8:9:10"]
    for r in pii.find(spark.createDataFrame([(t,) for t in texts], "text string"), pii_model).collect():
        spans = sorted((x.s, x.e) for x in [*r.base, *r.added])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)), r.text


def test_very_many_matches_in_a_text(spark, pii_model):
    text = "".join(f"u{i}@ex.com (555) 123-{i % 9000 + 1000} \U0001f600 " for i in range(1500))
    rows = pii.find(spark.createDataFrame([(text,)], "text string"), pii_model).first()
    assert [text[x.s : x.e] for x in rows.base if x.kind == "email"] == [f"u{i}@ex.com" for i in range(1500)]
    assert [text[x.s : x.e] for x in rows.added] == [f"(555) 123-{i % 9000 + 1000}" for i in range(1500)]


def test_personal_data_query(spark, tmp_path):
    """The base columns of the whole query against the plain patterns; added spans touch none of the base."""
    import hashlib

    from weirstream.llm.queries import op8_pii

    rng = random.Random(11)
    texts = TRICKY + ["".join(rng.choice("a1.@+- (5)4\n") for _ in range(60)) for _ in range(60)] + ["ring (030) 555 12 34 or jo [at] ex [dot] org"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op8_pii(spark, str(tmp_path)).collect()}
    order = lambda x: ((*pii.KINDS, "secret").index(x[0]), x[1])
    for i, t in enumerate(texts):
        base = sorted(plain_spans(t or ""), key=order)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        every = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in rows[i].spans.split(",") if x)]
        more = [x for x in every if x not in base]
        assert every == sorted(every, key=order) and rows[i].n_spans == len(every) and set(base) <= set(every)
        assert not any(a[1] < b[2] and b[1] < a[2] for a in more for b in base)
    assert {x.split(":")[0] for x in rows[len(texts) - 1].spans.split(",")} == {"phone", "email"}


def test_small_vocabularies_have_tries():
    for names in (["a", "b"], ["a", "ab", "\u2581"], [chr(i) for i in range(1, 256)], ["a" * i for i in range(1, 400)]):
        v = pieces.vocabulary(["<unk>", *names], {i + 1: -1.0 - i * 0.01 for i in range(len(names))}, (), 0)
        trie = pieces.DoubleArray([n.encode() for n in names])
        for number, name in enumerate(names):
            node = 0
            for b in name.encode():
                node = trie.base[node] + b
            assert trie.value[node] == number
        assert pieces.Codec(v).encode(names[0])[-1] == 1


def test_chunks_of_all_lengths_in_bounded_memory():
    import os
    import subprocess
    import sys

    code = """
import random, resource
resource.setrlimit(resource.RLIMIT_AS, (2 << 30, 2 << 30))
from weirstream.llm import pieces, queries
rng = random.Random(1)
word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
c = pieces.Codec(pieces.load(queries.default_model_file()))
texts = [" ".join(word(5) for _ in range(7000)), word(120_000), "x" * 1_000_000, " ".join(word(n) for n in range(1, 1500))]
ids, ends = c.encode_all(texts)
for t, a, b in zip(texts, ends[:-1], ends[1:]):
    assert c.decode(ids[a:b].tolist()) == t
    assert max(map(len, c.cache)) <= pieces.CACHED_BYTES
d = pieces.Codec(c.v)
for chunk in texts[3].split(" ")[::50]:
    assert list(d._segment(pieces.MARK + chunk)) == c.encode(chunk)
"""
    env = {**os.environ, "OPENBLAS_NUM_THREADS": "1", "ARROW_NUM_THREADS": "1"}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=240)
