"""Line dedup by winnowing over line hashes; DataFrame functions only.

A line here is a physical line cut further after sentences and before capitalised words
that begin some; what is longer than that, behind the first word of three or four letters
that has UNCUT words before it, or else after LONGEST words (see PIECE). A passage in the
middle of other text is so cut alike everywhere from the first sentence or short word on
at which both cuts meet.

1. Winnowing. Of every `window` neighbouring lines the least line hash is a fingerprint
   (lines of few words only if there are no others, and then the whole window is one).
   As a line has at most LONGEST words, `min_words` words that repeat hold a whole window,
   so every repeated run shares a fingerprint with its copy, and more every few lines.
2. Places. Fingerprints that occur more than once are joined to their places; windows
   `reach` lines either way of these places are the only ones that can be in a repeated run.
3. Extension. Each of these windows is joined to its own first place (by doc_id, then a
   hash of the text and position) by a hash of 64 bits; the lines of a window that is not at
   its first place are repeated, whichever document that was in, so other uses of a line
   hide nothing. Of 10^10 windows some three pairs of different ones have the same hash. Repeated lines that touch are one run, which so extends both ways as far as its
   copies do, even if parts of it have copies in different places.
4. Texts that are equal as a whole (by 96 bits of hashes) are told first; later ones are
   runs from end to end, and only the first of each is looked at by lines.

Runs of `min_words` words or more are deleted; what was the first occurrence of a run
stays. Of a passage that is cut out of sentences, the words before its first cut and
behind its last one stay.

Defined results: null text stays null; empty text stays empty; rows with a null doc_id or
without repeated runs keep their text; rows that share a doc_id and the text are treated
alike, those that share the doc_id only are taken in the order of a hash of their texts;
extra columns pass through untouched, whatever they are called; texts of any length are
read whole; an empty table stays empty. A document may end up empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import clear, cut, parted

#: Most words of a line; words of a long line before it may be cut behind any short word; words from which a line is a fingerprint on its own.
LONGEST, UNCUT, PLENTY = 10, 2, 4
#: Bits behind the number of a line for words, half of them of the line and half of its window.
AT = 16
# Java runs a greedy class in an atomic group in one loop, but steps through `\S++` and `\S{3,4}` by calls; and few words end with a mark, so that is asked before what stands before it.
_SEEN = r"[^ \t\n\x0B\f\r]"
_REST = rf"\p{{Ll}}(?>{_SEEN}*)"
#: A word and the blanks behind it, if no line ends there: with a sentence, a physical line, or before a capitalised word and three others.
_WORD = rf"(?>{_SEEN}+)(?<![.!?](?<=[^\p{{Lu}}\p{{P}}].))(?>[ \t]+)(?!\p{{Lu}}{_REST} {_REST} {_REST} \p{{Ll}})"
#: A line, its words as a group, or blanks alone.
PIECE = rf"(?>\s*)((?:{_WORD}){{0,{UNCUT}}}+(?:(?!{_SEEN * 4}?\s){_WORD}){{0,{LONGEST - UNCUT - 1}}}+(?>{_SEEN}+))(?>\s*)|\s++"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column, group: int = 0) -> Column:
    """The lines of a text; joined, they are the text. With group 1 without the blanks around them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(group))


def _values(bare: Column) -> Column:
    """Of each line: whether it has few words, 54 bits of its hash, and its words (at most LONGEST; more if blanks follow each other), from the high bits to the low ones."""
    # By the number of words, so that it is worked out once.
    low = F.array(*(F.lit(n + (n < PLENTY) * (1 << 62)).cast("long") for n in range(LONGEST + 1)))

    def value(line: Column) -> Column:
        # Few lines have tabs, and to look for one costs less than to replace none.
        plain = F.when(F.contains(line, F.lit("\t")), F.replace(line, F.lit("\t"), F.lit(" "))).otherwise(line)
        blanks = F.octet_length(line) - F.octet_length(F.replace(plain, F.lit(" "), F.lit("")))
        return F.xxhash64(line).bitwiseAND(F.lit((1 << 62) - 256)).bitwiseOR(F.get(low, F.least(blanks + 1, F.lit(LONGEST))))

    return F.transform(bare, value)


def _fingerprints(values: DataFrame, window: int) -> DataFrame:
    """(doc, at, h): for each window of values' v the least of its lines, unless that is the one of the window before.

    By a row for each line instead of functions over arrays, as Spark compiles only the former.
    """
    at = F.col("at")

    def lines(first: Column) -> list[Column]:
        return [F.get("v", first + k) for k in range(window)]

    def least(of: list[Column]) -> Column:
        return F.least(*of) if window > 1 else of[0]

    rows = values.select("doc", "v", F.posexplode("v").alias("at", "line")).filter(at <= F.size("v") - window)
    rows = rows.withColumn("m", least(lines(at)))
    # Of equal lines the last one is the least, so a line that comes in anew counts.
    alone = F.when((at == 0) | (F.col("m") != least(lines(at - 1))) | (F.col("m") == F.get("v", at + (window - 1))), F.col("m"))
    h = F.when(F.col("m") < F.lit(1 << 62), alone).otherwise(F.xxhash64(*lines(at)))
    return rows.select("doc", "at", h.alias("h")).filter("h is not null")


def _windows(v: Column, places: Column, window: int, reach: int) -> Column:
    """(h, at) of the windows around places: a hash; and the first line, with its words and those of the window in AT bits behind it."""

    def near(at: Column) -> Column:
        return F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.size(v) - window))

    def key(i: Column) -> Column:
        lines = [F.get(v, i + k) for k in range(window)]
        words = [x.bitwiseAND(255) for x in lines]
        at = F.shiftleft(i.cast("long"), AT) + F.shiftleft(words[0], AT // 2) + sum(words[1:], words[0])
        return F.struct(F.xxhash64(*lines).alias("h"), at.alias("at"))

    return F.transform(F.array_distinct(F.flatten(F.transform(places, near))), key)


def _longest(hits: Column, window: int) -> Column:
    """The words of the longest run of windows, or somewhat more where windows skip lines."""
    start = F.struct(F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("now"), F.lit(None).cast("long").alias("last"))

    def step(so: Column, x: Column) -> Column:
        all_, ago = x.bitwiseAND((1 << AT // 2) - 1), F.shiftright(x, AT) - F.shiftright(so["last"], AT)
        # Of the window before, what this one has no part in: its first line, or at most all of it.
        before = F.when(ago == 1, F.shiftright(so["last"], AT // 2)).otherwise(so["last"]).bitwiseAND((1 << AT // 2) - 1)
        now = F.when(ago <= window, so["now"] + before).otherwise(F.lit(0).cast("long"))
        return F.struct(F.greatest(so["most"], now + all_).alias("most"), now.alias("now"), x.alias("last"))

    return F.aggregate(F.array_sort(hits), start, step)["most"]


def _merged(spans: Column) -> Column:
    """Sorted spans (s, e) with touching and overlapping ones made one."""
    kind = "array<struct<s:int,e:int>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        apart = F.concat(done, F.array(x))
        return F.when(F.size(done) == 0, F.array(x)).when(last["e"] + 1 >= x["s"], joined).otherwise(apart)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def runs(docs: DataFrame, *, window: int = 2, reach: int = 1, min_words: int = 20) -> DataFrame:
    """docs with `runs`, array of (s, e, words): line numbers from 0 of what is repeated; and `left`, the rest of the text."""
    if not 0 < min_words < 256:
        raise ValueError("min_words must be from 1 to 255")
    if not 0 < window <= max(1, min_words // LONGEST) or reach < window - 1:
        raise ValueError("a window must fit in min_words words and reach must be at least one line less, or runs of few lines are missed")
    own = ["doc", "t"]
    keyed = [F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("t")]
    values = docs.filter(F.col("doc_id").isNotNull()).select(*keyed, F.xxhash64("text").alias("u"), _values(_lines(F.col("text"), 1)).alias("v"))
    values = cut(values).filter(F.size("v") >= window)
    # Whole copies are told by 96 bits of hashes of the texts; only the first of each is looked at by lines.
    texts = values.select(*own, "u", _words(F.col("v")).alias("words"))
    firsts = cut(texts.groupBy("t", "u").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first != last").drop("last"))
    copies = cut(texts.join(firsts, ["t", "u"]).filter("doc != first").select(*own, "words").distinct())

    marks = _fingerprints(values, window)
    # Six bytes do: two fingerprints taken for one are told apart by their windows, and shuffles are smaller.
    marks = marks.withColumn("h", F.shiftrightunsigned("h", 8).bitwiseAND((1 << 48) - 1))
    # Cut, so that the joins below shuffle both sides and a crowded key can be split.
    shared = cut(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    clear(docs.sparkSession)
    # One side of these joins has each key once, so a table of its rows does, and the other side needn't be sorted.
    places = marks.join(shared.hint("shuffle_hash"), "h").groupBy("doc").agg(F.collect_set("at").alias("ats"))
    near = values.select(*own, "v").join(places, "doc")
    # By the id alone, so that what is dealt by it needn't be shuffled again.
    near = near.join(copies.select(F.col("doc").alias("copy"), F.col("t").alias("ct")), (F.col("doc") == F.col("copy")) & (F.col("t").cast("long") - F.col("ct") == 0), "left_anti")
    near = cut(near.select(*own, _windows(F.col("v"), F.col("ats"), window, reach).alias("k")))
    del values, texts, firsts, marks, shared, places
    clear(docs.sparkSession)
    keys = near.select(*own, F.explode("k").alias("k")).select("k.h", *own, "k.at")
    place = F.struct(*own, "at")
    first = cut(keys.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last"))
    clear(docs.sparkSession)
    later = keys.join(first.hint("shuffle_hash"), "h").filter(F.col("first") < place).groupBy(own).agg(F.collect_set("at").alias("hits"))

    # What has too few words in any run stays as it is, and its text isn't looked at.
    later = later.filter(_longest(F.col("hits"), window) >= min_words).withColumn("hits", F.transform("hits", lambda x: F.shiftright(x, AT).cast("int")))
    gone = later.withColumn("whole", F.lit(None).cast("int")).unionByName(copies.filter(F.col("words") >= min_words).select(*own, F.lit(None).cast("array<int>").alias("hits"), F.col("words").alias("whole")))
    gone = cut(gone)
    del near, keys, first, later, copies
    clear(docs.sparkSession)
    # Only texts that change are shuffled.
    same, others = parted(docs, gone.select(F.col("doc").alias("doc_id")))
    joined = others.withColumns({f"__{c}": x for c, x in zip(own, keyed, strict=True)})
    joined = joined.join(gone.withColumnsRenamed({c: f"__{c}" for c in own}), [f"__{c}" for c in own], "left").drop(*(f"__{c}" for c in own))

    def found(lines: Column) -> Column:
        words = F.regexp_count(F.array_join(lines, ""), F.lit(r"\S++"))
        whole = F.filter(F.array(F.struct(F.lit(0).alias("s"), (F.size(lines) - 1).alias("e"), words.alias("words"))), lambda x: x["words"] >= min_words)
        return _let(F.when(F.col("whole").isNotNull(), whole).otherwise(_repeated(F.col("hits"), lines, window, min_words)), lambda r: F.struct(r.alias("runs"), kept_text(lines, r).alias("left")))

    joined = joined.unionByName(same.withColumns({"hits": F.lit(None).cast("array<int>"), "whole": F.lit(None).cast("int")}))
    joined = joined.withColumn("hits", F.when(F.col("hits").isNotNull() | F.col("whole").isNotNull(), _let(_lines(F.col("text")), found)))
    none = F.array().cast("array<struct<s:int,e:int,words:int>>")
    return joined.withColumns({"runs": F.coalesce("hits.runs", none), "left": F.coalesce("hits.left", "text")}).drop("hits", "whole")


def _words(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda n, x: n + x.bitwiseAND(255).cast("int"))


def _repeated(hits: Column, lines: Column, window: int, min_words: int) -> Column:
    """The runs of a document, from its windows that occurred before."""

    def counted(x: Column) -> Column:
        body = F.array_join(F.slice(lines, x["s"] + 1, x["e"] - x["s"] + 1), "")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.regexp_count(body, F.lit(r"\S++")).alias("words"))

    merged = _merged(F.transform(hits, lambda at: F.struct(at.alias("s"), (at + (window - 1)).alias("e"))))
    return F.filter(F.transform(merged, counted), lambda x: x["words"] >= min_words)


def kept_text(lines: Column, runs: Column) -> Column:
    """The text without the lines of the runs."""

    def gap(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["e"] + 1)
        stop = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["s"])
        return F.slice(lines, start + 1, stop - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap)), "")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with later repeated runs of lines deleted from text; n_chars, if there, follows."""
    own = docs.columns
    renamed = {c: f"__own_{c}" for c in ("left", "runs", "hits", "whole") if c in own}
    found = runs(docs.withColumnsRenamed(renamed), **how)
    if "n_chars" in own:
        n = F.when(F.size("runs") > 0, F.length("left").cast("long")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", n)
    return found.withColumn("text", F.col("left")).select(*[F.col(renamed.get(c, c)).alias(c) for c in own])
