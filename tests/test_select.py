import pytest

from weirstream.plans import select

COLUMNS = "manifest_id string, id string, ord long, media_type string, type_ord int, bandwidth long, width int, height int, codecs string, language string, name string, channels string, is_default boolean, audio_group string, subs_group string, group_id string, muxed_audio boolean, n_segs long, dur_s double"


def stream(id, kind, height=0, bandwidth=0, audio_group="", group="", lang="", muxed=False, n=0, dur=0.0):
    return ("m", id, 0, kind, ["video", "audio", "subtitles"].index(kind), bandwidth, 0, height, "", lang, "", "", False, audio_group, "", group, muxed, n, dur)


ROWS = [
    stream("v1", "video", 720, 2000000, "aud"), stream("v2", "video", 1080, 5000000, "aud"), stream("a1", "audio", 0, 128000, "", "aud", "en"),
    stream("a2", "audio", 0, 64000, "", "aud", "en"), stream("a3", "audio", 0, 128000, "", "aud", "de"), stream("a4", "audio", 0, 128000, "", "other", "fr"), stream("s1", "subtitles", lang="en"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r[:2], i, *r[3:]) for i, r in enumerate(rows)], COLUMNS)


def picked(df):
    return [r.id for r in df.orderBy("pick").collect()]


def test_default(spark):
    assert picked(select.select_streams(frame(spark))) == ["v2", "a1", "a3", "s1"]


def test_audio_selector(spark):
    assert len(select.select_streams(frame(spark), audio="lang=en", subs="none").filter("media_type = 'audio'").collect()) == 2
    assert picked(select.select_streams(frame(spark), video="none", audio="lang=en:for=best", subs="none")) == ["a1"]


def test_muxed_video_needs_no_variant(spark):
    rows = [stream("v1", "video", 720, 1, muxed=True), stream("a1", "audio", 0, 1)]
    assert picked(select.select_streams(frame(spark, rows))) == ["v1"]
    assert picked(select.select_streams(frame(spark, [stream("v1", "video", 720, 1), stream("a1", "audio", 0, 1)]))) == ["v1", "a1"]


def test_counts_and_lengths(spark):
    rows = [stream("x", "video", 3, n=75, dur=300.0), stream("y", "video", 2), stream("z", "video", 1, n=1, dur=4.0)]
    take = lambda text: [r.id for r in select.applied(select.ranked(frame(spark, rows)), select.parse(text)).orderBy("rank").collect()]
    assert take("segsmin=2:for=all") == ["x", "y"]
    assert take("plistdurmin=1m:for=all") == ["x", "y"]
    assert take("id!=^(x|y)$:for=all") == ["z"]
    assert take("range=x") == [] and take("best0") == []


@pytest.mark.parametrize("text", ["nonsense-without-equals", "lang=[unclosed", "for=some", "bwmin=x", "color=red", "plistdurmin=1x"])
def test_errors(text):
    with pytest.raises(select.SelectorError):
        select.parse(text)


def test_durations():
    assert select.duration("1h30m") == 5400 and select.duration("20") == 20 and select.duration("1.5s") == 1.5


def test_selectors_of_a_table(spark):
    rows = spark.createDataFrame([(1, "best2:x", "n"), (2, "all", "n"), (3, None, "n"), (4, "lang=fi:for=worst3", "n"), (5, "id=(", "n")], "k long, selector string, n string")
    got = {r.k: (r.ok, r.take, r.n, r.parts, bool(r.error)) for r in select.checked(rows).collect()}
    assert got == {1: (False, "", 0, 0, True), 2: (True, "all", 1, 0, False), 3: (False, "", 0, 0, True), 4: (True, "worst", 3, 1, False), 5: (False, "", 0, 0, True)}
    assert select.checked(rows.limit(0)).count() == 0
