"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by pattern: e-mail addresses, IPv4 addresses, telephone
numbers, card and account numbers, and people (a title or a known given name
with a surname). An entity's canonical form (digits of a number, lower case
of an address, given name and surname) decides its surrogate, so all its
mentions get the same one, each in its own format. Surrogates are drawn from
SHA-256 over a secret key, the kind, the canonical form and the number of
the draw. A draw that another entity also made, or that is itself an entity
of the corpus, is drawn again, until all surrogates are distinct.

All of it is DataFrame expressions. ``split`` and ``regexp_extract_all`` with
one pattern take a text apart and put it together again.

Cases: a null text stays null; rows repeated with one id get the same
surrogates; an empty table gives an empty result; all other columns of the
input are kept as they are; texts are handled whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.session import stage

# Given names by gender and script, the stock that surrogates come from.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Elena Sofia Clara Emma Nora Alice Ida Marta Helen Sarah Paula Irene Diana Eva Lucy Rosa".split(),
    ("m", "latin"): "Peter Paul Martin David Thomas Daniel Robert Oscar Simon Lucas Felix Hugo Adam Victor Bruno Carl James John Erik Leon".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Вера Нина".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Николай Дмитрий Павел Олег Виктор Борис".split(),
}
TITLES = {
    "m": "Mr Herr Monsieur Sir Señor Don Signor Господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Doña Signora Госпожа".split(),
    "n": "Dr Prof Doktor Professor".split(),
}
LETTERS = {"latin": ("bcdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}

WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
_titles = "|".join(t for group in TITLES.values() for t in group)
_given = "|".join(n for group in GIVEN.values() for n in group)
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])"),
    ("account", r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![\p{L}0-9])"),
    ("card", r"(?<![\p{L}0-9.+-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![\p{L}0-9])"),
    ("ssn", r"(?<![\p{L}0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}0-9-])"),
    ("phone", r"(?<![\p{L}0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\p{L}0-9])|\+[0-9]{8,15}(?![\p{L}0-9])"),
    ("person", rf"(?<![\p{{L}}0-9])(?:(?:{_titles})\.?\x20(?:(?:{_given})\x20)?{WORD}|(?:{_given})\x20{WORD})(?![\p{{L}}0-9])"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: A text without any of these has no entity: all kinds but people have a digit or an at sign.
SIGNS = "[0-9@]"
NAMES = rf"(?=\p{{Lu}})(?:(?:{_titles})\.?|(?:{_given}))\x20\p{{Lu}}"
DRAWS = 64


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    kind = F.lit("person")
    for name, pattern in reversed(KINDS[:-1]):
        kind = F.when(F.regexp_like(mention, F.lit(rf"\A(?:{pattern})\z")), name).otherwise(kind)
    return kind


def may_hold(text: Column) -> Column:
    """False for texts that surely have no entity; cheap, and never null."""
    return F.coalesce(F.regexp_like(text, F.lit(SIGNS)) | F.regexp_like(text, F.lit(NAMES)), F.lit(False))


def parts(text: Column) -> Column:
    """``found`` and the ``gaps`` around them, one more than there are entities."""
    return F.struct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"), F.split(text, PATTERN, -1).alias("gaps"))


def name_parts(mention: Column) -> tuple[Column, Column, Column]:
    """Title, given name and surname of a mention of a person; title and given name may be empty."""
    title = F.regexp_extract(mention, rf"\A((?:{_titles})\.?\x20)", 1)
    rest = F.substr(mention, F.char_length(title) + 1)
    given = F.regexp_extract(rest, rf"\A(?:({_given})\x20)", 1)
    return title, given, F.regexp_replace(rest, rf"\A(?:(?:{_given})\x20)(?=\p{{Lu}})", "")


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity share: digits, lower case, or the surname with its title's or given name's gender."""
    _, given, surname = name_parts(mention)
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "account", F.regexp_replace(mention, " ", ""))
        .when(kind == "email", F.lower(mention))
        .when(kind == "ip", mention)
        .otherwise(F.concat_ws(" ", given, surname))
    )


def stream(key: Column, kind: Column, entity: Column, draw: Column, salt: str) -> Column:
    """Hex digits that only the key's holder can foretell: 128 of them."""
    seed = F.concat_ws("\x1f", key, kind, entity, draw.cast("string"), F.lit(salt))
    return F.concat(F.sha2(F.concat(seed, F.lit("0")), 256), F.sha2(F.concat(seed, F.lit("1")), 256))


def pick(hexes: Column, at: Column, choices: str) -> Column:
    """One of the letters of ``choices`` by two hex digits at a place."""
    number = F.conv(F.substr(hexes, F.pmod(at * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
    return F.substr(F.lit(choices), F.pmod(number, F.lit(len(choices))) + 1, F.lit(1))


def disguised(text: Column, hexes: Column) -> Column:
    """Letters and digits exchanged for others of their class, script and case; all else kept."""
    chars = F.split(text, "")

    def other(c: Column, i: Column) -> Column:
        low = F.lower(c)
        new = F.when(c.rlike("[0-9]"), pick(hexes, i, "0123456789"))
        for consonants, vowels in LETTERS.values():
            for group in (vowels, consonants):
                drawn = pick(hexes, i, group)
                new = new.when(F.instr(F.lit(group), low) > 0, F.when(c == low, drawn).otherwise(F.upper(drawn)))
        latin, cyrillic = (pick(hexes, i, c + v) for c, v in LETTERS.values())
        new = new.when(low.rlike(r"\p{IsCyrillic}"), F.when(c == low, cyrillic).otherwise(F.upper(cyrillic)))
        return new.when(low.rlike(r"\p{L}"), F.when(c == low, latin).otherwise(F.upper(latin))).otherwise(c)

    return F.array_join(F.transform(chars, other), "")


def drawn(kind: Column, entity: Column, key: Column, draw: Column) -> Column:
    """The surrogate's canonical form."""
    hexes = stream(key, kind, entity, draw, "s")
    plain = disguised(entity, hexes)
    octets = [F.conv(F.substring(hexes, 1 + 4 * n, 4), 16, 10).cast("int") % 254 + 1 for n in range(4)]
    # Mailboxes keep the shape of the local part; hosts move below a domain that is never delivered to.
    local = disguised(F.substring_index(entity, "@", 1), hexes)
    # A late draw lengthens names and mailboxes, so that their number is without bound.
    longer = F.substring(F.translate(hexes, "0123456789", "ghijklmnop"), 1, F.greatest(draw - 3, F.lit(0)))
    given, surname = F.regexp_extract(entity, r"\A(\S+)\x20", 1), F.regexp_extract(entity, r"(\S+)\z", 1)
    new_given = F.lit("")
    for group, names in GIVEN.items():
        at = F.pmod(F.conv(F.substring(stream(key, F.lit("given"), entity, draw, "g"), 1, 6), 16, 10).cast("int"), F.lit(len(names)))
        new_given = F.when(given.isin(names), F.element_at(F.array(*map(F.lit, names)), at + 1)).otherwise(new_given)
    person = F.concat(F.when(new_given == "", "").otherwise(F.concat(new_given, F.lit(" "))), disguised(surname, hexes), longer)
    return (
        F.when(kind == "email", F.concat(local, longer, F.lit("@"), disguised(F.substring_index(F.substring_index(entity, "@", -1), ".", 1), stream(key, kind, entity, draw, "h")), F.lit(".example.net")))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "person", person)
        .otherwise(plain)
    )


def formatted(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: separators, title, letter case."""
    chars = F.split(mention, "")
    take = lambda c, n: F.substr(surrogate, n, F.lit(1))
    place = lambda i, keep: F.char_length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), keep, ""))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), take(c, place(i, "[^0-9]"))).otherwise(c)), "")
    account = F.array_join(F.transform(chars, lambda c, i: F.when(c != " ", take(c, place(i, " "))).otherwise(c)), "")
    title, _, _ = name_parts(mention)
    return (
        F.when(kind.isin("card", "ssn", "phone"), numbers)
        .when(kind == "account", account)
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(surrogate))
        .when(kind == "person", F.concat(title, surrogate))
        .otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate`` for distinct ``kind, entity``; no two entities of a kind share one, and none is an entity.

    Only entities whose draw collides go on to the next draw; of those that
    drew alike the least one keeps the draw.
    """
    secret = F.lit(key)
    waiting, done = entities, None
    for n in range(DRAWS):
        draws = stage(waiting.withColumn("surrogate", drawn(F.col("kind"), F.col("entity"), secret, F.lit(n))), "draws")
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        first = draws.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        won = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate")
        won = stage(won, "won")
        done = won if done is None else done.union(won)
        waiting = stage(draws.drop("surrogate").join(won, ["kind", "entity"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return done
    raise RuntimeError(f"{DRAWS} draws were not enough for distinct surrogates")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows and columns with the text rewritten and ``n_entities`` behind them (in place of a column of that name); and the surrogate table.

    The distinct mentions of the corpus are pre-aggregated by task. A row's
    mentions travel to the surrogates and back without its text; the text is
    joined to its own mentions' replacements by a hash of the text. Texts
    that cannot hold an entity stay where they are.
    """
    body = F.col(text_col).cast("string")
    plain, docs = docs.where(~may_hold(body)), docs.where(may_hold(body))
    mark = F.struct(F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("g"))
    apart = docs.select(mark.alias("mark"), F.array_distinct(parts(body)["found"]).alias("found")).where(F.size("found") > 0)
    apart = stage(apart.select("mark.h", "mark.g", F.explode("found").alias("mention")).distinct(), "mentions")
    mentions = apart.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    mentions = stage(mentions.withColumn("entity", canonical(F.col("kind"), F.col("mention"))), "entities")
    known = surrogates(mentions.select("kind", "entity").distinct(), key)
    spelled = mentions.join(known, ["kind", "entity"]).withColumn("new", formatted(F.col("kind"), F.col("mention"), F.col("surrogate")))
    spelled = stage(spelled.select("mention", "new", "kind", "entity", "surrogate"), "spelled")
    of_text = apart.join(spelled.select("mention", "new"), "mention").groupBy("h", "g").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("news")
    )
    of_text = stage(of_text, "replacements")
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark")).select("row", "mark.h", "mark.g")
    joined = rows.join(of_text, ["h", "g"], "left").select("row", F.col("row")[text_col].cast("string").alias("body"), "news")
    split = F.when(F.col("news").isNotNull(), parts(F.col("body")))
    woven = joined.select("row", "body", "news", split.alias("parts"))
    fresh = F.transform(F.col("parts.found"), lambda m: F.try_element_at("news", m))
    text = F.when(F.col("news").isNull(), F.col("body")).otherwise(
        F.array_join(F.flatten(F.zip_with("parts.gaps", F.concat(fresh, F.array(F.lit(""))), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    )
    n = F.when(F.col("news").isNull(), F.lit(0)).otherwise(F.size("parts.found")).cast("bigint")
    kept = [c for c in docs.columns if c != "n_entities"]
    done = woven.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in kept], n.alias("n_entities"))
    same = plain.select(*[(body if c == text_col else F.col(c)).alias(c) for c in kept], F.lit(0).cast("bigint").alias("n_entities"))
    return same.union(done), spelled


def pii_report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_entities, text_sha256`` with every entity replaced."""
    done, _ = replace_entities(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key)
    return done.select("doc_id", "text", "n_entities", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
