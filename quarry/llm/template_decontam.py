"""Operator 1: benchmark decontamination by template canonicalisation (DataFrame functions only).

Each word loses the marks around it; numbers, names (a capital followed by small letters) and units become typed
placeholders, and other words small letters.  A window of eight such tokens, with enough plain words, is a template; eight
words in small letters, without placeholders, are a second form of the same window, for names written in
another case.  A window of an item matches where either form is equal.

The join runs from rare words: each window of an item is entered under its longest plain word, for long words are rare.
Documents' words join these entries, and only where the words beside agree as well are templates made and compared.  Matches of a document and an item on one alignment are counted; an alignment is judged where half
of the item's windows match, or six (13 words on end).  Its slots are compared: the same benchmark value must always stand
for the same value in the document, so a re-parameterised question is found and an accident of placeholders is not.
Each alignment is judged; the best consistent one is returned.

Items under eight words are one window of their own length; items under SHORTEST words say too little and are not searched,
nor are windows without a letter or digit.  The benchmark's side is broadcast up to a bound and shuffled beyond it.
Null and empty texts, on either side, match nothing; rows without an id are left out; repeated rows of a document or an item
count once, and of rows of one id with different texts each is compared; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

WINDOW = 8
#: Of a window's tokens so many at least are not placeholders.
PLAIN = 4
#: Items of fewer words are not searched.
SHORTEST = 5
PLACES = ("<num>", "<name>", "<unit>")
#: Rows of some hundred bytes that may be broadcast; beyond it the join shuffles.
WIDE_ROWS = 30_000
#: Windows on one alignment that are enough for any item, and the share of an item's windows that is enough.
ENOUGH, SHARE = 6, 0.5
#: Equals no word, for it holds a space.
BEYOND = "\x00 "
SPACE = " \t\n\x0b\f\r"
MARKS = ".,;:!?\"'()[]{}<>*#&%$|-_/\\~`^+=@“”‘’«»…"
NUMBER = r"^[0-9][0-9.,:/]*(st|nd|rd|th)?$"
NAME = r"^\p{Lu}\p{L}*\p{Ll}\p{L}*$"
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion half twice".split()
UNITS = (
    "mm cm km kg mg gram grams kilogram kilograms metre metres meter meters mile miles inch inches foot feet yard yards litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees dollar dollars euro euros cent cents percent"
).split()


def words_of(text: str) -> Column:
    return F.split(F.btrim(F.col(text), F.lit(SPACE)), r"[ \t-\r]+")


def folds_of(text: str) -> Column:
    """``fold`` of each of ``words_of``, made of the whole text at once: marks beside white space go with it."""
    marks = "[" + "".join("\\" + c for c in MARKS) + "]"
    inner = F.btrim(F.lower(F.btrim(F.col(text), F.lit(SPACE))), F.lit(MARKS))
    return F.split(inner, rf"{marks}*[ \t-\r]+{marks}*")


def fold(w) -> Column:
    return F.lower(F.btrim(w, F.lit(MARKS)))


def token(w) -> Column:
    """A placeholder, or the word in small letters."""
    core, low = F.btrim(w, F.lit(MARKS)), fold(w)
    number = core.rlike(NUMBER) | low.isin(NUMBER_WORDS)
    return F.when(number, "<num>").when(core.rlike(NAME), "<name>").when(low.isin(UNITS), "<unit>").otherwise(low)


def _plain(t) -> Column:
    return (t != "") & ~t.isin(*PLACES)


def item_windows(items: DataFrame) -> DataFrame:
    """(key, at, size, typed): the windows to search of each item; typed, whether its template is specific enough."""
    size = F.least(F.lit(WINDOW), F.size("tokens"))
    windows = items.select("key", "tokens", "folds", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("tokens") - size)).alias("at"))
    here = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    typed = F.size(F.filter(here("tokens"), _plain)) >= PLAIN
    return windows.where(F.exists(here("folds"), lambda x: x != "")).select("key", "at", "size", typed.alias("typed"))


def anchors(items: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, key, place, begin, folds, tokens, size, starts, l1 .. r3): for each window its longest plain word and the words
    around it; starts are the windows that hold the place, and whether they are typed; l and r are ``beside``."""
    words = items.select("key", F.posexplode(F.arrays_zip("tokens", "folds")).alias("place", "w")).select("key", "place", F.col("w.folds").alias("word"), _plain(F.col("w.tokens")).alias("plain"))
    words = words.where("word <> ''")
    held = windows.join(words, "key").where("place >= at and place < at + size and (plain or not typed)")
    longest = F.min(F.struct((-F.length("word")).alias("size"), "word", "place")).alias("w")
    chosen = held.groupBy("key", "at").agg(longest).select("key", F.col("w.place").alias("place")).distinct()
    around = windows.join(chosen, "key").where("place >= at and place < at + size")
    around = around.groupBy("key", "place").agg(F.min("at").alias("begin"), F.max(F.expr("at + size")).alias("end"), F.first("size").alias("size"), F.collect_list(F.struct("at", "typed")).alias("starts"))
    part = lambda c: F.slice(c, F.col("begin") + 1, F.col("end") - F.col("begin")).alias(c)
    return around.join(items, "key").select(F.element_at("folds", F.col("place") + 1).alias("word"), "key", "place", "begin", part("folds"), part("tokens"), "size", "starts", *_beside())


def _beside() -> list[Column]:
    """The words up to three places before (l) and behind (r) an anchor; null where anything may stand: for a placeholder, or where
    a short window needs fewer; a mark that no word equals beyond the item's ends.  Of a window's other words more than half
    stand on one side of the anchor, so all three of that side must agree."""
    out = []
    for side, sign in (("l", -1), ("r", 1)):
        for j in (1, 2, 3):
            at = F.col("place") + sign * j
            there = (at >= 0) & (at < F.size("folds"))
            word = F.when(~there, BEYOND).when(~F.get("tokens", at).isin(*PLACES), F.get("folds", at))
            out.append(F.when(F.ceil((F.col("size") - 1) / 2) >= j, word).alias(f"{side}{j}"))
    return out


def _agrees() -> Column:
    """Whether a document's words (folds, around pos) agree with all of one side of an anchor."""
    same = lambda side, sign: F.expr(" and ".join(f"({side}{j} is null or coalesce(get(folded, pos + {sign * j}) = {side}{j}, false))" for j in (1, 2, 3)))
    return same("l", -1) | same("r", 1)


def _matched() -> Column:
    """The item's windows that match around an anchor: columns words, pos of the document and those of ``anchors``."""
    shift = F.col("pos") - F.col("place")
    first = F.greatest(F.col("begin"), -shift)  # of the item's words around the anchor, the first that the document can have
    theirs = F.slice("words", first + shift + 1, F.size("folds"))
    rest = lambda c: F.slice(c, first - F.col("begin") + 1, F.size(c))
    bits = lambda form, c: F.array_join(F.zip_with(theirs, rest(c), lambda w, x: F.when(form(w) == x, "1").otherwise("0")), "")
    run = F.repeat(F.lit("1"), F.col("size"))

    def hit(s, z):
        holds = lambda found: F.substr(found, s["at"] - z["first"] + 1, F.col("size")) == run
        return (s["at"] >= z["first"]) & (holds(z["exact"]) | (s["typed"] & holds(z["templates"])))

    once = F.array(F.struct(first.alias("first"), bits(fold, "folds").alias("exact"), bits(token, "tokens").alias("templates")))
    return F.element_at(F.transform(once, lambda z: F.transform(F.filter("starts", lambda s: hit(s, z)), lambda s: s["at"])), 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: id, item, matched and all windows, slots, changed slots."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    items = items.select(F.xxhash64("item", "text").alias("key"), "item", words_of("text").alias("w")).where(F.size("w") >= SHORTEST)
    items = cut(items.select("key", "item", F.transform("w", token).alias("tokens"), F.transform("w", fold).alias("folds")), "op1-items")
    windows = cut(item_windows(items), "op1-windows")
    need = windows.groupBy("key").agg(F.count("*").alias("n_windows"), F.first("size").alias("size"))

    each = docs.select("id", "text", folds_of("text").alias("folded")).select("id", "text", "folded", F.posexplode("folded").alias("pos", "word"))
    entries = small_side(cut(anchors(items, windows), "op1-anchors"), WIDE_ROWS)
    met = each.join(entries, "word").where(_agrees()).withColumn("words", words_of("text"))
    met = met.select("id", "key", (F.col("pos") - F.col("place")).alias("shift"), F.explode(_matched()).alias("at")).distinct()
    met = met.groupBy("id", "key", "shift").agg(F.count("*").alias("matched"), F.collect_list("at").alias("at"))
    met = cut(met.join(small_side(cut(need, "op1-need"), WIDE_ROWS), "key").where(f"matched >= least({ENOUGH}, ceil({SHARE} * n_windows))"), "op1-met")

    # slots of the words that matched, for the documents concerned
    concerned = docs.join(small_side(cut(met.select("id").distinct(), "op1-concerned")), "id", "left_semi").select("id", words_of("text").alias("words")).distinct()
    both = met.join(concerned, "id").join(items, "key")
    pairs = F.zip_with("tokens", "folds", lambda t, f: F.struct(t.alias("t"), f.alias("f")))
    pairs = F.transform(pairs, lambda p, i: F.struct(p["t"].alias("t"), p["f"].alias("x"), i.alias("i"), F.exists("at", lambda a: (i >= a) & (i < a + F.col("size"))).alias("covered")))
    pairs = F.filter(pairs, lambda p: p["covered"] & p["t"].isin(*PLACES))
    slots = F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), fold(F.get("words", p["i"] + F.col("shift"))).alias("y")))
    both = both.withColumn("slots", F.array_distinct(slots))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["x"])))
    judged = both.where(consistent).select(
        "id", "item", "shift", "matched", "n_windows", F.size("slots").cast("long").alias("n_slots"), F.size(F.filter("slots", lambda s: s["x"] != s["y"])).cast("long").alias("n_changed")
    )
    best = judged.groupBy("id", "item").agg(F.max(F.struct("matched", (-F.col("shift")).alias("back"), "n_windows", "n_slots", "n_changed")).alias("b"))
    return best.select("id", "item", "b.matched", "b.n_windows", "b.n_slots", "b.n_changed")


_PLACE = "'<num>', '<name>', '<unit>'"


def _token_sql(x: str) -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    core = _core_sql(x)
    return (
        f"CASE WHEN regexp_matches({core}, '{NUMBER}') OR lower({core}) IN ({quoted(NUMBER_WORDS)}) THEN '<num>' "
        f"WHEN regexp_matches({core}, '{NAME}') THEN '<name>' WHEN lower({core}) IN ({quoted(UNITS)}) THEN '<unit>' ELSE lower({core}) END"
    )


def _core_sql(x: str) -> str:
    return f"trim({x}, '{MARKS.replace(chr(39), chr(39) * 2)}')"


_BOTH = f"list_transform(words, lambda w: {_token_sql('w')}) AS tokens, list_transform(words, lambda w: lower({_core_sql('w')})) AS folds"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
dt AS (SELECT doc_id, {_BOTH} FROM d),
b AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM benchmark WHERE text IS NOT NULL),
bt AS (SELECT item_id, least(len(words), {WINDOW}) AS size, {_BOTH} FROM b WHERE len(words) >= {SHORTEST}),
bw AS (
  SELECT item_id, size, i, array_to_string(tokens[i:i + size - 1], ' ') AS t, array_to_string(folds[i:i + size - 1], ' ') AS f,
    len(list_filter(tokens[i:i + size - 1], lambda x: x NOT IN ({_PLACE}) AND x <> '')) >= {PLAIN} AS typed
  FROM (SELECT *, unnest(range(1, len(tokens) - size + 2)) AS i FROM bt) WHERE len(list_filter(folds[i:i + size - 1], lambda x: x <> '')) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(tokens[i:i + size - 1], ' ') AS t, array_to_string(folds[i:i + size - 1], ' ') AS f
  FROM (SELECT *, unnest(range(1, len(tokens) - size + 2)) AS i FROM dt, sizes)),
need AS (SELECT item_id, count(*) AS n_windows FROM bw GROUP BY item_id),
hits AS (
  SELECT doc_id, item_id, bw.size, dw.i - bw.i AS shift, bw.i AS i FROM dw JOIN bw ON dw.size = bw.size AND dw.f = bw.f UNION
  SELECT doc_id, item_id, bw.size, dw.i - bw.i, bw.i FROM dw JOIN bw ON dw.size = bw.size AND dw.t = bw.t WHERE typed),
met AS (
  SELECT doc_id, item_id, shift, n_windows, matched FROM (SELECT doc_id, item_id, shift, count(*) AS matched FROM hits GROUP BY ALL) JOIN need USING (item_id)
  WHERE matched >= least({ENOUGH}, ceil({SHARE} * n_windows))),
covered AS (SELECT DISTINCT doc_id, item_id, shift, k FROM (SELECT *, unnest(range(i, i + size)) AS k FROM hits)),
pairs AS (
  SELECT doc_id, item_id, shift, matched, n_windows, bt.tokens[k] AS t, bt.folds[k] AS x, dt.folds[k + shift] AS y
  FROM met JOIN covered USING (doc_id, item_id, shift) JOIN bt USING (item_id) JOIN dt USING (doc_id)),
slots AS (
  SELECT doc_id, item_id, shift, matched, n_windows, count(DISTINCT CASE WHEN t IN ({_PLACE}) THEN x END) AS xs,
    count(DISTINCT CASE WHEN t IN ({_PLACE}) THEN x || chr(31) || y END) AS n_slots,
    count(DISTINCT CASE WHEN t IN ({_PLACE}) AND x <> y THEN x || chr(31) || y END) AS n_changed
  FROM pairs GROUP BY ALL)
SELECT doc_id, item_id, matched::BIGINT AS matched, n_windows::BIGINT AS n_windows, n_slots::BIGINT AS n_slots, n_changed::BIGINT AS n_changed
FROM slots WHERE xs = n_slots QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) = 1
"""
