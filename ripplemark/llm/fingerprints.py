"""Document fingerprints of closed syncmers, as DataFrame expressions.

A text is a sequence of words: what stands between white space, where each
sign of a script without spaces is a word by itself. Of its k-mers (k words in a
row) those are anchors whose least inner substring (s words in a row, by
hash) is the first or the last one. Whether a k-mer is an anchor depends on
its own words alone, so an edit changes anchors around it and leaves all
others where they are. Both ends of a text are padded with k - s empty words,
so that short texts have anchors, too.

A fingerprint holds the anchors' hashes in the order of the text, 24 bits
each, base64. Likeness counts anchors that two fingerprints share: the n-th
place of an anchor in one is matched with its n-th place in the other, and
twice the matches are divided by the anchors of both (Dice).

Cases: null is the empty text; texts without words have an empty fingerprint;
two empty fingerprints are alike (1), an empty and another are not (0); texts
of any length are read whole; order is by id, largest first, null last, and
by a hash of the text among equal ids; rows repeated whole follow each other;
an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import small_side, text_of
from ripplemark.session import stage

#: Words of an anchor, and of the inner substrings of which the least counts.
K, S = 5, 2
#: Signs of scripts that set no spaces between words: Thai to Burmese, Khmer, East Asian ones.
UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\uD7A3\uF900-\uFAFF\x{20000}-\x{3FFFF}"
WORDS = rf"[^\s{UNSPACED}]+|[{UNSPACED}]"
#: Bits of a printed hash, and characters that it takes.
BITS, CODE = 24, 4
NAME = ["no_id", "id", "h"]


def word_hashes(text: Column, k: int = K, s: int = S) -> Column:
    """Hashes of the words between the empty words of the padding."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))
    padding = F.array_repeat(F.lit(0).cast("bigint"), k - s)
    return F.concat(padding, found, padding)


def with_place(place: Column, code: Column) -> Column:
    return F.struct(place.alias("place"), code.alias("code"))


def with_anchors(rows: DataFrame, text: str, name: str, k: int = K, s: int = S, told=with_place) -> DataFrame:
    """The rows with ``name``: the anchors of column ``text`` in order, an array of what ``told`` makes of place and code.

    The place is the number of the anchor's first word, the text's first word
    being 0; anchors that begin in the padding have negative places. A
    column that is looked at for every element is one of its own, since
    Spark would work it out anew for each.
    """
    words, inner = f"{name}_words", f"{name}_inner"
    reach = k - s
    rows = rows.withColumn(words, word_hashes(F.col(text), k, s))
    several = lambda at, n: [F.get(F.col(words), at + j) for j in range(n)]
    rows = rows.withColumn(inner, F.transform(words, lambda w, i: F.xxhash64(w, *several(i + 1, s - 1))))
    later = lambda i, j: F.get(F.col(inner), i + j)
    code = lambda i: F.xxhash64(*several(i, k)).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).cast("int")
    chosen = lambda h, i: F.when(
        F.least(h, later(i, reach)) <= F.least(*[later(i, j) for j in range(1, reach)]), told(i - reach, code(i))
    )
    n_words = F.size(words) - 2 * reach
    whole = F.slice(inner, F.lit(1), F.when(n_words > 0, n_words + 2 * reach - k + 1).otherwise(0))
    return rows.withColumn(name, F.filter(F.transform(whole, chosen), lambda a: a.isNotNull())).drop(words, inner)


def with_codes(rows: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """The rows with ``name``: the codes of the anchors of column ``text`` in order."""
    return with_anchors(rows, text, name, k, s, lambda place, code: code)


def printed(codes: Column) -> Column:
    """The codes in order, four characters each."""
    hexes = F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), BITS // 4, "0")), "")
    return F.translate(F.base64(F.unhex(hexes)), "\r\n", "")


def running_most(numbers: Column, size: Column) -> Column:
    """Largest of the first 1, 2, … of ``size`` numbers, by doubling."""
    top = F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    steps = F.when(size < 2, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0))), lambda e: F.pow(F.lit(2.0), e).cast("int"))
    )
    shifted = lambda acc, by: F.slice(F.concat(F.array_repeat(F.lit(0), by), acc), F.lit(1), F.size(acc))
    return F.aggregate(steps, numbers, lambda acc, by: F.zip_with(acc, shifted(acc, by), lambda x, y: F.greatest(x, y)))


def with_tokens(rows: DataFrame, codes: str, name: str) -> DataFrame:
    """The rows with ``name``: numbers for the codes of a fingerprint, the n-th place of a code having its own."""
    held = f"{name}_sorted"
    rows = rows.withColumn(held, F.sort_array(codes))
    size, wide = F.size(held), F.col(held).cast("array<bigint>")
    begins = F.transform(held, lambda c, i: F.when((i > 0) & (F.get(F.col(held), i - 1) == c), 0).otherwise(i))
    places = F.zip_with(F.sequence(F.lit(0), size - 1), running_most(begins, size), lambda i, begin: (i - begin).cast("bigint"))
    numbered = F.zip_with(wide, places, lambda c, n: c + F.shiftleft(n, BITS))
    distinct = F.size(F.array_distinct(held)) == size
    return rows.withColumn(name, F.when(distinct, wide).otherwise(numbered)).drop(held)


def likeness(one: str, other: str) -> Column:
    """Dice likeness of two columns of :func:`with_tokens`."""
    total = F.size(one) + F.size(other)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(one, other)) / total)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``no_id, id, h, body``: a row's name is its id, null last, and a hash of its text."""
    body = text_of(text_col)
    return docs.select(
        F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(body).alias("h"), body.alias("body")
    )


def followers(names: DataFrame) -> DataFrame:
    """Distinct names with the name that follows by id, largest first: ``no_id, id, h, next_no_id, next_id, next_h, more``.

    The names are sorted once; a row's successor is the next one of its sorted
    partition, found by its number, or the first one of the next partition
    that has rows, of which there is one per partition. ``more`` carries the
    other columns of ``names``.
    """
    more = [c for c in names.columns if c not in NAME]
    ordered = names.orderBy("no_id", F.desc("id"), "h").select(*NAME, *more, F.monotonically_increasing_id().alias("at"))
    ordered = stage(ordered, "order")
    part = F.shiftright("at", 33)
    starts = ordered.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) == 0).select(*NAME, part.alias("part"))
    # One row per partition of the sort; the last one is followed by the first.
    turn = Window.orderBy("part")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrapped = [F.coalesce(F.lead(c).over(turn), F.first(c).over(whole)).alias(f"start_{c}") for c in NAME]
    starts = F.broadcast(stage(starts.select("part", *wrapped), "starts"))
    later = ordered.select((F.col("at") - 1).alias("at"), *[F.col(c).alias(f"later_{c}") for c in NAME])
    linked = ordered.join(later, "at", "left").withColumn("part", part).join(starts, "part")
    follows = [F.coalesce(f"later_{c}", f"start_{c}").alias(f"next_{c}") for c in NAME]
    return linked.select(*NAME, *follows, *more)


def once(rows: DataFrame, again: DataFrame) -> DataFrame:
    """One row of each name. ``again``: the names that occur more than once."""
    if again.isEmpty():
        return rows
    twice = small_side(again)
    return rows.join(twice, NAME, "left_anti").union(rows.join(twice, NAME, "left_semi").dropDuplicates(NAME))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Every row with the start of the next document and its codes: ``no_id, id, body, head, next_codes``.

    ``head`` has as many characters as a third of ``body``. The text moves
    once, and a third of it a second time; names are joined first.
    """
    rows = named(docs, id_col, text_col)
    sizes = rows.groupBy(*NAME).agg(F.count(F.lit(1)).alias("copies"), F.max(F.char_length("body")).alias("size"))
    links = stage(followers(sizes), "links")
    again = stage(links.where("copies > 1").select(*NAME), "again")
    texts = once(rows, again)
    asked = links.select(*[F.col(f"next_{c}").alias(c) for c in NAME], *[F.col(c).alias(f"for_{c}") for c in NAME], F.floor(F.col("size") / 3).cast("int").alias("cut"))
    heads = texts.join(small_side(asked), NAME)
    heads = with_codes(heads, "body", "next_codes", k, s)
    heads = heads.select(*[F.col(f"for_{c}").alias(c) for c in NAME], F.substring("body", F.lit(1), F.col("cut")).alias("head"), "next_codes")
    beside = texts.join(heads, NAME).select("no_id", "id", "body", "head", "next_codes")
    if again.isEmpty():
        return beside
    # A repeated row is followed by its like, but for the last one.
    copies = small_side(stage(links.where("copies > 1").select(*NAME, "copies"), "copies"))
    own = with_codes(texts.join(copies, NAME), "body", "next_codes", k, s)
    cut = F.floor(F.char_length("body") / 3).cast("int")
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies"))))
    return beside.union(own.select("no_id", "id", "body", F.substring("body", F.lit(1), cut).alias("head"), "next_codes"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next document.

    Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    rows = beside_next(docs, id_col, text_col, k, s)
    size = F.char_length("body")
    rows = rows.withColumn("edited", F.concat(F.substring("body", F.lit(1), size - F.floor(size / 3).cast("int")), F.col("head")))
    rows = rows.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), size.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "body", "edited", "next_codes",
    )
    rows = with_codes(rows, "body", "codes", k, s).drop("body")
    rows = with_codes(rows, "edited", "edited_codes", k, s).drop("edited")
    for codes, tokens in (("codes", "own"), ("edited_codes", "changed"), ("next_codes", "following")):
        rows = with_tokens(rows, codes, tokens)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("codes")).alias("fingerprint"), printed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Every row's fingerprint and anchors: ``doc_id, fingerprint, anchors`` (array of ``place, code``)."""
    rows = with_anchors(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body")), "body", "anchors", k, s)
    return rows.select("doc_id", printed(F.col("anchors.code")).alias("fingerprint"), "anchors")
