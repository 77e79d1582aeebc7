"""Personal data: wide generators, boosted trees, calibrated thresholds (operator 8, native).

Four base patterns give spans that always stay. Wide generators propose
overlapping spans of looser shapes: written-out addresses, numbers without a plus
or with a failing check digit, network addresses of other notations, keys and tokens.
Boosted trees on their format and context score them, and those above their kind's
calibrated threshold are added; of spans that overlap the likeliest stays.

The trees learn from plants: texts with a span of a known kind, or of one that only
looks alike (dates, versions, sums, order and tracking numbers, scores, digests,
clock times, paths), written from templates by seeds. What is right is known for
each, whatever the base patterns say. The thresholds are calibrated on templates and
cue words that were held out from fitting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import aside, staged

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: ``secret`` has no base pattern.
ALL_KINDS = (*KINDS, "secret")

# Equal to the plain patterns but linear in time: possessive where nothing can be given back, and an
# email starts where its run of characters does (or where the match before it ended).
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind, which spares the pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Wide generators. Each is linear in the text: runs are possessive and start where the characters before them end.
_NAME, _HOST = r"\p{L}\p{N}._%+-", r"\p{L}\p{N}_-"
_DOT = r"(?:\.++|\x20?[\[(][Dd][Oo][Tt][\])]\x20?|\x20[Dd][Oo][Tt]\x20)"
WIDE = {
    # round an at sign, written out or not
    "address": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++(?:(?:@|\x20?[\[(][Aa][Tt][\])]\x20?)[{_HOST}]++(?:{_DOT}[{_HOST}]++)*+|\x20[Aa][Tt]\x20[{_HOST}]++(?:(?:\.|\x20[Dd][Oo][Tt]\x20)[{_HOST}]++)++)",
    # 7 digits or more with separators
    "number": r"(?<![0-9])\+?[(]?(?=[0-9]++[\x20().,/-]{1,2}[0-9])[0-9](?:[\x20().,/-]{0,2}[0-9]){6,}+",
    # 7 digits or more without
    "run": r"(?<![0-9])[0-9]{7,}+",
    # groups of a network address with colons, or with brackets round its dots
    "net": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,}+(?![\p{L}\p{N}])|(?<![0-9])[0-9]{1,3}(?:\x20?[\[(](?:\.|[Dd][Oo][Tt])[\])]\x20?[0-9]{1,3}){3}(?![0-9])",
    # 16 characters or more of a key, with letters and digits
    "key": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
}
#: A text without a match of this has no candidate.
WIDE_NEEDS = {"address": "@", "number": "[0-9]", "run": "[0-9]{7}", "net": r":[0-9A-Fa-f]{0,4}:|[0-9]\x20?[\[(](?:\.|[Dd])", "key": "[0-9]"}
#: The same for addresses without an at sign: each begins with one character, which is quick to look for.
_WRITTEN_AT = (r"[\[(][Aa][Tt][\])]", rf"\x20[Aa][Tt]\x20[{_HOST}]++(?:\.|\x20[Dd][Oo][Tt]\x20)[{_HOST}]")

#: Matches that are added up in one fold; folds of folds keep texts with very many matches linear.
FOLD = 256
_SPANS = "array<struct<s:int,e:int,hit:string>>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,hit>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Splitting by the pattern gives what lies between the matches; adding up
    lengths gives the places, in blocks of ``FOLD`` matches first.
    """
    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.split(text, pattern, -1).alias("gap")), lambda x: x["hit"].isNotNull())

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit")))).alias("out"))

    def block(a: Column, b: Column) -> Column:
        def moved(r: Column) -> Column:
            out = F.transform(r["out"], lambda x: F.struct((x["s"] + a["at"]).alias("s"), (x["e"] + a["at"]).alias("e"), x["hit"].alias("hit")))
            return F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(out)).alias("out"))

        return _let(F.aggregate(b, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")), step), moved)

    def in_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / FOLD).cast("int")), lambda i: F.slice(p, i * FOLD + 1, F.lit(FOLD)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), block, lambda a: a["out"]))

    return _let(pairs, in_blocks)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    digits = F.reverse(_digits(hit))

    def step(a: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10) == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(hit)).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
    }[kind]


def _passes(kind: str):
    return lambda x: _valid(kind, x["hit"])


def is_kind(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans of the base pattern that pass its check."""
    none = F.array().cast("array<struct<s:int,e:int,hit:string>>")
    need = {"card": text.rlike("[0-9]"), "ip": text.rlike("[0-9]")}
    return {k: F.when(need.get(k, F.contains(text, F.lit(NEEDS[k]))), F.filter(spans(text, BASE[k]), _passes(k))).otherwise(none) for k in KINDS}


def candidates(text: Column) -> Column:
    """array<struct<s,e,hit,before,after>>: what the wide generators propose; spans of different ones may overlap."""
    none = F.array().cast(_SPANS)
    needs = {g: text.rlike(rx) for g, rx in WIDE_NEEDS.items()}
    needs["address"] = F.contains(text, F.lit("@")) | text.rlike(_WRITTEN_AT[0]) | text.rlike(_WRITTEN_AT[1])
    found = F.concat(*[F.when(needs[g], spans(text, rx)).otherwise(none) for g, rx in WIDE.items()])
    around = lambda at, n: F.lower(F.substr(text, at, n))
    return F.transform(
        found,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["hit"].alias("hit"),
            around(F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))).alias("before"),
            around(x["e"] + 1, F.lit(12)).alias("after"),
        ),
    )


_AT = r"@|[\[(][Aa][Tt][\])]|\x20[Aa][Tt]\x20"


def features(x: Column) -> dict[str, Column]:
    """Format and context of a candidate."""
    hit, before, after = x["hit"], x["before"], x["after"]
    count = lambda c, rx: F.regexp_count(c, F.lit(rx)).cast("double")
    says = lambda rx: before.rlike(rx).cast("double")
    digits = F.length(_digits(hit))
    return {
        "length": F.length(hit).cast("double"),
        "digits": digits.cast("double"),
        "letters": count(hit, r"\p{L}"),
        "capitals": count(hit, "[A-Z]"),
        "beyond_hex": count(hit, "[g-zG-Z]"),
        "at": hit.rlike(_AT).cast("double"),
        "plus": hit.startswith("+").cast("double"),
        "dots": count(hit, r"\."),
        "commas": count(hit, ","),
        "slashes": count(hit, "/"),
        "hyphens": count(hit, "[-_]"),
        "blanks": count(hit, r"\x20"),
        "brackets": count(hit, r"[()\[\]]"),
        "groups": count(hit, "[0-9]+"),
        "longest_group": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+"), 0), F.length)), F.lit(0)).cast("double"),
        "first_group": F.length(F.regexp_extract(hit, "[0-9]+", 0)).cast("double"),
        "last_group": F.length(F.regexp_extract(hit, "([0-9]*)$", 1)).cast("double"),
        "zero_first": F.regexp_extract(hit, "[0-9]", 0).eqNullSafe("0").cast("double"),
        "as_year": hit.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])|^20[0-9]{6}").cast("double"),
        "ends_as_host": hit.rlike(r"(?i)(?:\.|dot[\])]?\x20?)\p{L}{2,}$").cast("double"),
        "key_prefix": hit.rlike("^(?:ghp_|gho_|AKIA|sk-|sk_|xox[a-z]-|AIza|eyJ)").cast("double"),
        "glued_before": before.rlike("[\\p{L}\\p{N}_/.]$").cast("double"),
        "glued_after": after.rlike("^[\\p{L}\\p{N}_/]").cast("double"),
        "assigned": before.rlike("[=:]\\x20?[\"']?$").cast("double"),
        "colons": count(hit, ":"),
        "double_colon": F.contains(hit, F.lit("::")).cast("double"),
        "bracketed_dots": count(hit, r"[\[(](?:\.|[Dd][Oo][Tt])[\])]"),
        "fours": count(hit, "(?<![0-9])[0-9]{4}(?![0-9])"),
        "spelled_out": hit.rlike(r"\x20[Aa][Tt]\x20").cast("double"),
        "in_path": before.rlike(r"[/=&?][^\x20]*$").cast("double"),
        "says_unit": after.rlike(r"^[\x20]?(?:points|px|items|rows|units|votes|times|steps|km|kg|ms|%)").cast("double"),
        "says_host": says("host|server|address|ping|addr|route|node"),
        "says_parcel": says("track|transact|shipment|serial|refer|receipt|stamp|batch|score|result|tally|lot"),
        "says_mail": says("mail|contact|write to|reach"),
        "says_phone": says("phone|tel|call|fax|mobile|dial|whatsapp"),
        "says_card": says("card|visa|pay|account|iban"),
        "says_secret": says("token|secret|passw|pwd|api.?key|key|bearer|auth|credential"),
        "says_digest": says("commit|sha|md5|hash|digest|checksum|etag|uuid|rev"),
        "says_count": says("order|number|no\\.|page|isbn|ean|version|build|ticket|invoice|total|about|population|since|from|on|at|of|id"),
    }


def kind_of(x: Column) -> Column:
    """The kind of an added span, by its shape."""
    hit, digits = x["hit"], F.length(_digits(x["hit"]))
    return (
        F.when(hit.rlike(_AT), F.lit("email"))
        .when(hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$|:[0-9A-Fa-f]{{0,4}}:|^[0-9]{{1,3}}\x20?[\[(](?:\.|[Dd])"), F.lit("ip"))
        .when(hit.rlike(r"\p{L}"), F.lit("secret"))
        .when((digits >= 13) & hit.rlike(r"^[0-9]{13,19}$|^[0-9]{4}(?:[\x20.-][0-9]{4}){3,4}$|^[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}$"), F.lit("card"))
        .otherwise(F.lit("phone"))
    )


@dataclass(frozen=True)
class PiiModel:
    """cuts: for each kind the least probability of an added span; above 1 none of the kind is added."""

    trees: boosting.BoostedTrees | None
    cuts: tuple[tuple[str, float], ...]

    def cut(self, kind: Column) -> Column:
        out = F.lit(2.0)
        for k, c in self.cuts:
            out = F.when(kind == k, F.lit(c)).otherwise(out)
        return out


def _touches(x: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _is_base(hit: Column) -> Column:
    """The candidate as a whole is what a base pattern finds: no need to look for it among the base spans."""
    n = F.length(_digits(hit))
    return hit.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$") | (hit.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$") & n.between(8, 15))


# What plants are made of. # is a digit, ~ a hexadecimal digit, ^ a letter or digit, ? a small letter.
_CALL, _MAIL, _KEY = ("call", "tel.", "phone:", "mobile", "fax", "dial"), ("mail", "contact", "write to", "e-mail:", "reach me:"), ("token =", "secret:", "password =", "api_key =", "key:", "bearer", "auth_token:")
_CARD, _HOSTS = ("card", "visa", "pay with", "account", "card no:"), ("host", "server", "address", "ping", "addr:", "node")
_COUNT, _PARCEL = ("order number", "order", "ticket", "invoice no.", "id", "no."), ("tracking no.", "transaction id", "shipment", "serial number", "reference", "receipt", "timestamp", "batch")
_PLANTS = [
    # kind or none, cue needed (1), possible (0) or none (-1), cues, templates
    ("email", 0, _MAIL, ("????(at)?????.com", "????.??? [at] ????? [dot] org", "????## (at) ????.net", "??.????@?????é.com", "é???@????.org", "?????[AT]????.co.uk", "??(at)??.com", "?? (at) ??.org", "??? [at] ?? [dot] net", "??@??é.com", "???@é???.net", "??.???@???ü???.org", "?????_?@ñ????.com", "??@????ö.eu", "????? (at) ????????.eu", "???_??[at]?????.io")),
    ("email", 1, _MAIL, ("?????? at ????? dot com", "????_## at ???????.de", "????? at ???? dot co dot uk", "?? [at] ???.com", "??? at ???? dot net", "???????? at ?????? dot org", "???? at ????????.fr")),
    ("phone", 0, _CALL, ("(###) ###-####", "###-###-####", "###.###.####", "0## #######", "0### ######", "0## ########", "00## ## #######", "0# ## ## ## ##", "0##/#######", "(0##) ### ## ##", "0### ### ###", "(0##) ########", "00## # ## ## ## ##", "(###) ### ####")),
    ("phone", 1, _CALL, ("##########", "0##########", "### ### ####", "#########", "## ### ## ##", "#######", "### ## ## ##", "########", "0#########", "########", "###########", "#########", "### #### ###", "#######", "0########", "#########")),
    ("card", 1, _CARD, ("################", "#### #### #### ####", "####-####-####-####", "####.####.####.####", "3### ###### #####", "3##############", "4###############", "5### #### #### ####", "####-####-####-####", "#### #### #### ####", "6###############", "5###############")),
    ("ip", 0, _HOSTS, ("##[.]##[.]##[.]##", "1##[.]##[.]#[.]##", "10(.)#(.)#(.)##", "192[dot]168[dot]#[dot]##", "20##:db8:~~~~:~~~~::~~", "fe80::~~~~:~~~~:~~~~:~~~~", "~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~", "2a0#:~~~~:~~~::#", "1##[.]1##[.]##[.]#", "20##:~~~~:~~~~:~~::~~~~", "fd~~:~~~~:~~~~::~")),
    ("secret", 1, _KEY, ("~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "^^^^^^^^^^^^^^^^^^^^^^^^", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "^^^^^^^^^^^^^^^^^^^^", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^")),
    ("secret", 0, ("token =", "use", "with", "key:"), ("ghp_^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "AKIA^^^^^^^^^^^^^^^^", "sk-^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "xoxb-###########-^^^^^^^^^^^^^^^^", "gho_^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "AKIA^^^^^^^^^^^^^^^^", "AIza^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^")),
    (None, 0, ("on", "since", "from", "dated", "of"), ("20##-0#-1#", "1#.0#.20##", "0#/1#/20##", "20##-20##", "19##-20##", "20##0#1#", "20##0#1#1#0###", "20##-0#-1# 1#.4#", "1#/0#/19##", "19##.0#.1#")),
    (None, 0, ("total", "about", "sum of", "population", "of"), ("#,###,###", "##,###,###.##", "#.###.###,##", "###,###.##", "#.########", "0.########", "##.######, ##.######", "### ### ###", "# ### ###", "###,###,###", "## ### ###")),
    (None, 0, ("version", "build", "release", "v"), ("#.#.#.#.#.#.#", "##.#.####.###", "#.##.######", "#.#.#.#, #.#.#.#", "#.#.#######", "##.##.##.##.##")),
    (None, 1, _COUNT, ("#########", "##########", "########", "###########", "######-####", "###-#######", "################", "####-####-####", "#### #### ####")),
    (None, 1, _PARCEL, ("################", "94##############", "17##########", "17###########", "#### #### ####", "####-####-####", "######## ########", "1###############", "#### #### #### ####", "###############", "##########", "###-###-####")),
    (None, 1, ("score", "final score", "result", "tally"), ("### ### #### points", "## ### ### points", "### ### ###", "### ### #### votes", "####### points")),
    (None, -1, (), ("#########", "########", "#######", "##########", "1#########", "1############", "####################", "########################", "################", "#### #### #### ####", "### ### ####")),
    (None, 0, ("isbn", "ean", "see"), ("97#-#-##-######-#", "97#-##-####-###-#", "97###########", "4############", "97# # ### ##### #")),
    (None, 0, ("page", "rows", "of", "see"), ("12, 14, 18, 2#, 3#", "1 2 3 4 5 6 7 #", "1# 2# 3# 4# 5#", "1#/2#/3#/4#", "###, ###, ###", "1#-2#-3#-4#")),
    (None, 1, ("commit", "sha256:", "md5:", "hash", "checksum", "etag:", "rev"), ("~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~")),
    (None, -1, (), ("~~~~~~~~-~~~~-~~~~-~~~~-~~~~~~~~~~~~", "?????_??????_????_20##", "IMG_20##0#1#_1#0###", "???????##??????-?????", "?????-???-?????-??-####", "???????????####????", "?????/????/#####/?????", "########-####-####-####-############")),
    (None, -1, (), ("????x####x##???_???????????", "####x####x##???_???????????", "/????/????????????####/?????", "https://????.??/????????????####/???", "????=????????########", "https://????.??/?/################", "/var/????/????????-########/??")),
    (None, 0, ("meet", "lunch", "we sat", "walk"), ("?? ???? at ???? dot ???", "???? at ???? dot com", "????? at ????.??", "?? at ####.#", "@????.??????", "????@?", "?????@????", "????? (at) ###", "???? at ??? dot ?", "?????? at ????? dot org", "??? at ??????.de")),
    (None, 0, ("at", "from", "since", "mac", "took", "ratio"), ("1#:2#:4#", "0#:1#:3#:2#", "~~:~~:~~:~~:~~:~~", "1#:2#:4#:3##", "1#:9#:4#", "20##:0#:1#:1#:3#", "a~:~~:~~:~~:~~:~~", "1##:2##:3##")),
]


def plants(spark: SparkSession, n: int, seed: str = "plants") -> DataFrame:
    """place, t, s, e, kind (null: only looks alike), template, cue: ``n`` texts with one plant each, of all families and templates in turn. The same for the same seed.

    ``template`` and ``cue`` count those of a family, so that whole ones can be held out.
    """
    flat = [(kind, need, list(cues) or [""], t, at) for kind, need, cues, templates in _PLANTS for at, t in enumerate(templates)]
    families = [[f for f in flat if (f[0] is not None) == right] for right in (False, True)]
    rows = spark.range(n).select("id")
    pick = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(m)).cast("int")
    literal = lambda fs: F.array(*[F.struct(F.lit(a).cast("string").alias("kind"), F.lit(b).alias("need"), F.array(*map(F.lit, c)).alias("cues"), F.lit(t).alias("template"), F.lit(at).alias("nth")) for a, b, c, t, at in fs])
    place = (F.col("id") / 2).cast("int")
    one = F.when(F.col("id") % 2 == 0, F.element_at(literal(families[0]), place % len(families[0]) + 1)).otherwise(F.element_at(literal(families[1]), place % len(families[1]) + 1))
    digest = lambda salt: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), F.col("id")).cast("binary"), 256)
    pools = {
        "#": F.translate(digest("d"), "abcdef", "172839"),
        "~": digest("h"),
        "^": F.translate(F.concat(F.base64(F.unhex(digest("b"))), F.base64(F.unhex(digest("c")))), "+/=", "x7Q"),
        "?": F.translate(digest("l"), "0123456789abcdef", "etaoinshrdlucmwp"),
    }
    rows = rows.select("id", one.alias("f"), *[c.alias(f"pool{i}") for i, c in enumerate(pools.values())], digest("w").alias("w"))

    def filled(i: Column) -> Column:
        out = ch = F.substr(F.col("f.template"), i, F.lit(1))
        for at, mark in enumerate(pools):
            out = F.when(ch == mark, F.substr(F.col(f"pool{at}"), i, F.lit(1))).otherwise(out)
        return out

    hit = F.array_join(F.transform(F.sequence(F.lit(1), F.length("f.template")), filled), "")
    words = F.translate("w", "0123456789abcdef", "etaoin hrd ucm w")
    nth_cue = pick("cue", 64) % F.size("f.cues")
    cue = F.element_at(F.col("f.cues"), nth_cue + 1)
    with_cue = (F.col("f.need") == 1) | ((F.col("f.need") == 0) & (pick("says", 5) < 2))
    quote = F.element_at(F.array(*map(F.lit, ("", "", "", '"', "(", "| "))), pick("quote", 6) + 1)
    before = F.concat(F.substr(words, F.lit(1), F.lit(10) + pick("n", 20)), F.element_at(F.array(F.lit(" "), F.lit(", "), F.lit(". ")), pick("sep", 3) + 1), F.when(with_cue, F.concat(cue, F.lit(" "))).otherwise(F.lit("")), quote)
    after = F.concat(F.element_at(F.array(*map(F.lit, (" ", ". ", ", ", "!! ", '" ', "### ", ") "))), pick("end", 7) + 1), F.substr(words, F.lit(40), F.lit(20)))
    rows = rows.select("id", F.col("f.kind").alias("kind"), F.col("f.nth").alias("template"), F.when(with_cue, nth_cue).otherwise(F.lit(-1)).alias("cue"), before.alias("b"), hit.alias("h"), after.alias("a"))
    shout = pick("shout", 12) == 0
    text = F.concat("b", "h", "a")
    return rows.select(F.col("id").alias("place"), F.when(shout & (F.col("kind") == "email"), F.upper(text)).otherwise(text).alias("t"), F.length("b").alias("s"), (F.length("b") + F.length("h")).alias("e"), "kind", "template", "cue")


def planted_candidates(rows: DataFrame) -> DataFrame:
    """place, template, cue, kind, label and features of the candidates in planted texts; one is right if it is a plant of its kind, to a character at either end."""
    base = F.flatten(F.array(*base_spans(F.col("t")).values()))
    proposed = rows.withColumn("base", base).withColumn("x", F.explode(candidates(F.col("t")))).filter(~_touches(F.col("x"), F.col("base")))  # as ``find`` does
    found = proposed.filter(_touches(F.col("x"), F.array(F.struct("s", "e"))))
    right = F.col("kind").eqNullSafe(kind_of(F.col("x"))) & (F.abs(F.col("x.s") - F.col("s")) <= 1) & (F.abs(F.col("x.e") - F.col("e")) <= 1)
    return found.select("place", "template", "cue", kind_of(F.col("x")).alias("kind"), right.cast("int").alias("label"), *[c.alias(k) for k, c in features(F.col("x")).items()])


def held_out(template: Column, cue: Column) -> Column:
    """Every fourth template of a family, and every fourth cue."""
    return (template % 4 == 3) | (cue % 4 == 3)


_fitted: dict[tuple, PiiModel] = {}


def fit(spark: SparkSession, n_plants: int = 16_000, precision: float = 0.9, rounds: int = 14, depth: int = 5) -> PiiModel:
    """Trees from ``n_plants`` texts with plants, thresholds from templates and cues that the trees haven't seen.

    A kind's threshold is the least probability from which on ``precision`` of its
    held-out candidates are right. The model depends on the plants and the
    parameters alone, so it is the same for every table, also an empty one, and is
    fitted once a session.
    """
    key = (spark.sparkContext.applicationId, n_plants, precision, rounds, depth)
    if key not in _fitted:
        rows = staged(planted_candidates(plants(spark, n_plants)), "planted")
        held = held_out(F.col("template"), F.col("cue"))
        names = [c for c in rows.columns if c not in ("place", "template", "cue", "kind", "label")]
        trees = boosting.fit(rows.filter(~held), names, "label", rounds, depth)
        scored = staged(rows.filter(held).select("kind", "label", trees.probability(F.col).alias("p")), "scored")
        _fitted.clear()
        _fitted[key] = PiiModel(trees, tuple((k, boosting.threshold(scored.filter(F.col("kind") == k), "label", precision)) for k in ALL_KINDS))
    return _fitted[key]


def quality(spark: SparkSession, model: PiiModel, n: int = 8000, seed: str = "judged") -> DataFrame:
    """kind, right, accepted, both: plants of another seed whose template or cue is held out, found by ``find`` or not; recall is both / right, precision both / accepted."""
    rows = plants(spark, n, seed).filter(held_out(F.col("template"), F.col("cue")))
    found = find(rows.withColumnsRenamed({"s": "at", "e": "until"}), model, "t")
    near = lambda x: (F.abs(x["s"] - F.col("at")) <= 1) & (F.abs(x["e"] - F.col("until")) <= 1)
    spans = F.concat("base", "added")
    found = found.withColumn("hit", F.exists(spans, lambda x: near(x) & (x["kind"] == F.col("kind")))).withColumn("all", F.explode_outer(F.filter("added", lambda x: (x["s"] < F.col("until")) & (F.col("at") < x["e"]))))
    right = found.filter("kind IS NOT NULL").dropDuplicates(["place"]).groupBy("kind").agg(F.count(F.lit(1)).alias("right"), F.count_if("hit").alias("found"))
    accepted = found.filter("all IS NOT NULL").withColumn("good", near(F.col("all")) & F.col("kind").eqNullSafe(F.col("all.kind")))
    accepted = accepted.groupBy(F.col("all.kind").alias("kind")).agg(F.count(F.lit(1)).alias("accepted"), F.count_if("good").alias("good"))
    return right.join(accepted, "kind", "full").na.fill(0)


def find(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: array<struct<kind,s,e>>, by kind as listed in KINDS, then start.

    Columns of these names are replaced. Null texts count as empty and have none. Every span is found inside its row,
    so neither long texts nor repeated rows move any data. No added span touches a base span, nor one that is likelier
    than itself.
    """
    docs, names = aside(docs.drop("base", "added"))
    text = next((now for now, before in names.items() if before == text), text)
    docs = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    raw = docs.withColumn("__b", F.struct(*[c.alias(k) for k, c in base_spans(F.col("__t")).items()]))
    tagged = lambda k: F.transform(F.col("__b")[k], lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    out = raw.withColumn("base", F.concat(*[tagged(k) for k in KINDS]))
    if model.trees is None:
        return out.withColumn("added", F.array().cast("array<struct<kind:string,s:int,e:int>>")).drop("__t", "__b").withColumnsRenamed(names)
    fresh = F.filter(candidates(F.col("__t")), lambda x: ~_is_base(x["hit"]) & ~_touches(x, F.col("base")))
    known = F.transform(fresh, lambda x: F.struct(kind_of(x).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.struct(*[c.alias(k) for k, c in features(x).items()]).alias("f")))
    scored = F.transform(known, lambda x: F.struct(model.trees.probability(lambda name: x["f"][name]).alias("p"), (x["e"] - x["s"]).alias("n"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    taken = F.filter(scored, lambda x: x["p"] >= model.cut(x["kind"]))
    # of spans that overlap, the likelier one, then the longer one, then the later one stays
    alone = lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y > x) & (y["s"] < x["e"]) & (x["s"] < y["e"])))
    added = F.transform(_let(taken, alone), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return out.withColumn("added", added).drop("__t", "__b").withColumnsRenamed(names)


def in_order(found: Column) -> Column:
    """Spans by kind as listed, then start."""
    return F.concat(*[F.array_sort(F.filter(found, is_kind(k))) for k in ALL_KINDS])


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by <kind>; overlapping spans by the first's kind."""
    found = find(docs, model, text)
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    whole = F.coalesce(F.col(text), F.lit(""))

    def step(a: Column, x: Column) -> Column:
        piece = F.when(x["s"] >= a["at"], F.concat(F.substr(whole, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substr(whole, a["at"] + 1, F.length(whole) + 1)))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), clean)).drop("base", "added")
