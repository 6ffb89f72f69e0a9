"""Settings of one configuration text as an array of facts (no UDF).

Each builder takes a text Column and returns
``array<struct<key string, value string, value_type string>>`` with one
entry per key; where a key repeats, the last one wins. ``value_type`` is
string, int, float, bool, null or list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACT = "struct<key:string,value:string,value_type:string>"
FACTS = f"array<{FACT}>"

# ---- fixed values: the expressions that define the formats ----
LINE_BREAK_RE = "\\r\\n|\\r|\\n"
WHITE_SPACE = "[\\s\\p{Z}\\x1c-\\x1f\\x85]"
OUTER_SPACE_RE = f"^{WHITE_SPACE}+|{WHITE_SPACE}+$"
JS_EXPORT_RE = "(?s)(?:module\\.exports|export\\s+default)\\s*=\\s*\\{(.*)\\}\\s*;?\\s*$"
JS_ASSIGNED_RE = "(?s)=\\s*\\{(.*)\\}"
JS_LINE_COMMENT_RE = "//[^\\n]*"
JS_BLOCK_COMMENT_RE = "(?s)/\\*.*?\\*/"
JS_PAIR_RE = (
    "([A-Za-z_][A-Za-z0-9_]*)\\s*:\\s*"
    "(?:\"([^\"]*)\"|'([^']*)'|([0-9]+(?:\\.[0-9]+)?)|(true|false|null))"
)
# ---- end of fixed values ----


def strip(text: Column) -> Column:
    """White space removed at both ends."""
    return F.regexp_replace(text, OUTER_SPACE_RE, "")


def fact(key: Column, value: Column, value_type: Column) -> Column:
    return F.struct(key.alias("key"), value.cast("string").alias("value"), value_type.alias("value_type"))


def no_facts() -> Column:
    return F.array().cast(FACTS)


def lines(text: Column) -> Column:
    """Lines as read in universal-newline mode, stripped."""
    return F.transform(F.split(text, LINE_BREAK_RE), strip)


def last_per_key(facts: Column) -> Column:
    """Keep the last fact of each key.

    Sorting by (key, position) and comparing neighbours takes n log n; the
    single-element transform binds the sorted array once.
    """
    placed = F.transform(
        facts, lambda f, i: F.struct(f.key.alias("key"), i.alias("place"), f.alias("fact"))
    )
    kept = F.transform(
        F.array(F.array_sort(placed)),
        lambda ordered: F.transform(
            F.filter(
                F.arrays_zip(ordered.alias("cur"), F.slice(ordered, 2, F.size(ordered)).alias("nxt")),
                lambda pair: ~F.coalesce(pair["nxt"].key == pair["cur"].key, F.lit(False)),
            ),
            lambda pair: pair["cur"].fact,
        ),
    )
    return F.get(kept, F.lit(0))


def properties_facts(text: Column) -> Column:
    """``key=value`` or ``key: value`` lines; '#' and '!' begin comments."""
    live = F.filter(lines(text), lambda ln: (ln != "") & ~ln.rlike("^[#!]") & ln.rlike("[=:]"))

    def to_fact(ln: Column) -> Column:
        cut = F.when(ln.contains("="), F.instr(ln, "=")).otherwise(F.instr(ln, ":"))
        return fact(strip(F.substring(ln, F.lit(1), cut - 1)), strip(F.substr(ln, cut + 1)), F.lit("string"))

    return last_per_key(F.transform(live, to_fact))


def env_facts(text: Column) -> Column:
    """``KEY=value`` lines; one pair of matching quotes is removed."""
    live = F.filter(lines(text), lambda ln: ~ln.startswith("#") & ln.contains("="))

    def to_fact(ln: Column) -> Column:
        cut = F.instr(ln, "=")
        value = strip(F.substr(ln, cut + 1))
        quoted = value.rlike("(?s)^\".*\"$|^'.*'$") & (F.length(value) >= 2)
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return fact(strip(F.substring(ln, F.lit(1), cut - 1)), bare, F.lit("string"))

    return last_per_key(F.transform(live, to_fact))


def js_facts(text: Column) -> Column:
    """``ident: literal`` pairs of an exported or assigned object.

    Nesting collapses to bare keys; quoted true, false and null count as
    the bare words, as in the format's definition.
    """
    exported = F.regexp_extract_all(text, F.lit(JS_EXPORT_RE), F.lit(1))
    assigned = F.regexp_extract_all(text, F.lit(JS_ASSIGNED_RE), F.lit(1))
    body = F.get(F.when(F.size(exported) > 0, exported).otherwise(assigned), F.lit(0))
    body = F.regexp_replace(F.regexp_replace(body, JS_LINE_COMMENT_RE, ""), JS_BLOCK_COMMENT_RE, "")
    pairs = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(JS_PAIR_RE), F.lit(0))

    def to_fact(pair: Column) -> Column:
        key = F.regexp_extract(pair, JS_PAIR_RE, 1)
        number = F.regexp_extract(pair, JS_PAIR_RE, 4)
        # exactly one of the four groups is non-empty, or the literal is ''
        literal = F.concat(*[F.regexp_extract(pair, JS_PAIR_RE, i) for i in (2, 3, 4, 5)])
        return (
            F.when(literal == "null", fact(key, F.lit(None), F.lit("null")))
            .when(literal.isin("true", "false"), fact(key, literal, F.lit("bool")))
            .when(number.contains("."), fact(key, number.cast("double"), F.lit("float")))
            .when(number != "", fact(key, F.regexp_replace(number, "^0+([0-9])", "$1"), F.lit("int")))
            .otherwise(fact(key, literal, F.lit("string")))
        )

    return last_per_key(F.transform(pairs, to_fact))


# --------------------------------------------------------- comparisons --


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def comparable(value: Column, value_type: Column) -> Column:
    """Text equal for equal settings: "30" differs from 30, 1 equals 1.0 and true."""
    number = value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(2.0**53))
    return (
        F.when(value_type == "null", F.lit(None).cast("string"))
        .when(value_type == "bool", F.when(value == "true", "n:1").otherwise("n:0"))
        .when(value_type == "int", F.concat(F.lit("n:"), value))
        .when(
            value_type == "float",
            F.concat(F.lit("n:"), F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))),
        )
        .otherwise(F.concat(F.substring(value_type, 1, 1), F.lit(":"), value))
    )
