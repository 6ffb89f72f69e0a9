"""Configuration files to settings, and what changed between two revisions."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import facts as X
from ripplemark.functions import paths as P
from ripplemark.session import stage

FACT_ROWS = "path string, key string, value string, value_type string"
SERVICE_ROWS = "path string, service string"

# ---- fixed values ----
JS_CONFIG_NAME_RE = "\\.config\\.(?:js|ts|mjs|cjs)$"
FORMAT_OF_EXTENSION = {
    "yml": "yaml", "yaml": "yaml", "json": "json", "properties": "properties", "xml": "xml",
    "env": "env", "js": "js", "ts": "js", "mjs": "js", "cjs": "js",
}
HOST_RE = "^([a-z][a-z0-9\\-]*service)(?::[0-9]+)?$"
# ---- end of fixed values ----


def config_format(path: Column | str) -> Column:
    """Reader of a file by name; NULL where none applies."""
    ext = P.extension(path)
    chosen = F.when(F.lower(P.file_name(path)).rlike(JS_CONFIG_NAME_RE), "js")
    for fmt in dict.fromkeys(FORMAT_OF_EXTENSION.values()):
        chosen = chosen.when(ext.isin([e for e, f in FORMAT_OF_EXTENSION.items() if f == fmt]), fmt)
    return chosen


# ------------------------------------------------ formats read natively --


def _native_facts(files: DataFrame) -> DataFrame:
    """Properties, env and JS texts."""
    text = F.col("content")
    finished = (
        F.when(F.col("format") == "properties", X.properties_facts(text))
        .when(F.col("format") == "env", X.env_facts(text))
        .when(F.col("format") == "js", X.js_facts(text))
    )
    wanted = files.filter(F.col("format").isin("properties", "env", "js"))
    return wanted.select("path", F.explode(finished).alias("f")).select("path", "f.key", "f.value", "f.value_type")


# --------------------------------- formats read in Arrow-fed Python tasks --

# Facts of one frame that a Python task hands over.
FACTS_AT_ONCE = 10_000


def _leaves(tree: object, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted keys of nested mappings in document order; other values are leaves.

    Shared nodes are walked once per path to them and never copied. A node
    inside itself is an error.
    """
    on_path: set[int] = set()
    todo: list[tuple] = [(prefix, tree, False)] if isinstance(tree, dict) else []
    while todo:
        parent, node, done = todo.pop()
        if done:
            on_path.discard(id(node))
        elif isinstance(node, dict):
            if id(node) in on_path:
                raise ValueError("a mapping contains itself")
            on_path.add(id(node))
            todo.append((parent, node, True))
            todo.extend((f"{parent}.{k}" if parent else str(k), v, False) for k, v in reversed(node.items()))
        else:
            yield parent, node


def _may_collide(trees: list[tuple[str, object]]) -> bool:
    """Whether two leaves can have one dotted key: by a dot in a key, by keys that print alike, or by one prefix."""
    if len({prefix for prefix, _ in trees}) < len(trees):
        return True
    seen: set[int] = set()
    todo = [tree for _, tree in trees]
    while todo:
        node = todo.pop()
        if isinstance(node, dict) and id(node) not in seen:
            seen.add(id(node))
            names = {str(k) for k in node}
            if len(names) < len(node) or any("." in n for n in names):
                return True
            todo.extend(node.values())
    return False


def _facts_of(trees: list[tuple[str, object]]) -> Iterator[tuple[str, object]]:
    """Leaves of prefixed trees; of equal keys the last one counts.

    Aliases can make a small text have very many leaves, so they are only
    held together where keys can be equal.
    """
    for _, tree in trees:
        _check_cycles(tree)
    leaves = ((key, value) for prefix, tree in trees for key, value in _leaves(tree, prefix))
    yield from dict(leaves).items() if _may_collide(trees) else leaves


def _check_cycles(tree: object) -> None:
    """Raises for a node that contains itself, through mappings or lists; each node is visited once."""
    finished: set[int] = set()
    on_path: set[int] = set()
    todo: list[tuple[object, bool]] = [(tree, False)]
    while todo:
        node, done = todo.pop()
        if done:
            on_path.discard(id(node))
            finished.add(id(node))
        elif isinstance(node, (dict, list, tuple)) and id(node) not in finished:
            if id(node) in on_path:
                raise ValueError("a node contains itself")
            on_path.add(id(node))
            todo.append((node, True))
            todo.extend((v, False) for v in (node.values() if isinstance(node, dict) else node))


class _Piece(str):
    """Text that is printed as it is."""


def _scalar(value: object) -> object:
    """One form of whole numbers; what JSON does not know is its text."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)


def _printed(value: object) -> str:
    """A list as JSON with sorted members, so that equal lists print alike; of any depth."""
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        node = todo.pop()
        if isinstance(node, _Piece):
            out.append(node)
            continue
        if isinstance(node, dict):
            named = sorted({str(k): v for k, v in node.items()}.items())
            parts = [(_Piece(json.dumps(k, ensure_ascii=False) + ":"), v) for k, v in named]
            begin, end = "{", "}"
        elif isinstance(node, (list, tuple, set, frozenset)):
            ordered = sorted(node, key=lambda v: str(_scalar(v))) if isinstance(node, (set, frozenset)) else node
            parts = [(v,) for v in ordered]
            begin, end = "[", "]"
        else:
            out.append(json.dumps(_scalar(node), ensure_ascii=False))
            continue
        out.append(begin)
        todo.append(_Piece(end))
        for n in range(len(parts) - 1, -1, -1):
            todo.extend(reversed(parts[n]))
            if n:
                todo.append(_Piece(","))
    return "".join(out)


def _text(value: str) -> str:
    """The text with lone surrogates replaced, which UTF-8 cannot hold."""
    return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _typed(value: object) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return str(value).lower(), "bool"
    if isinstance(value, (int, float)):
        return str(value), type(value).__name__
    if isinstance(value, (list, set, tuple)):
        return _text(_printed(value)), "list"
    # a date is not the text that looks like it
    return _text(str(value)), "string" if isinstance(value, str) else type(value).__name__


def _yaml_documents(text: str) -> list[object]:
    """Documents of a YAML text; none where it does not parse. A missing library is an error of the job."""
    import yaml  # looked up where the text is read

    try:
        return list(yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
    except MemoryError:
        raise
    except Exception:  # a text that does not parse has no settings
        return []


def _yaml_facts(text: str) -> Iterator[tuple[str, object]]:
    trees = []
    for position, doc in enumerate(_yaml_documents(text)):
        if isinstance(doc, dict):
            metadata = doc.get("metadata", {})
            unnamed = f"doc{position}"
            name = metadata.get("name", unnamed) if isinstance(metadata, dict) else unnamed
            trees.append((f"{doc.get('kind', unnamed)}/{name}", doc))
    return _facts_of(trees)


def _xml_facts(text: str) -> Iterator[tuple[str, object]]:
    root = ElementTree.fromstring(text)
    leaves: dict[str, object] = {}
    todo = [(root.tag, root)]
    while todo:
        key, element = todo.pop()
        below = [(f"{key}.{child.tag}", child) for child in element]
        if below:
            todo.extend(reversed(below))
        else:
            leaves[key] = (element.text or "").strip()
    return iter(leaves.items())


def _json_facts(text: str) -> Iterator[tuple[str, object]]:
    return _facts_of([("", json.loads(text))])


ARROW_READERS = {"yaml": _yaml_facts, "xml": _xml_facts, "json": _json_facts}


def _rows_of(path: str, fmt: str, content: str | None) -> Iterator[tuple]:
    """Facts of one file. A text that cannot be read has none, and costs no other file its own."""
    try:
        for key, value in ARROW_READERS[fmt](content or ""):
            yield path, _text(key), *_typed(value)
    except (ValueError, TypeError, RecursionError, ElementTree.ParseError):
        return


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Facts in frames of bounded length."""
    rows = (
        row
        for batch in batches
        for path, fmt, content in zip(batch["path"], batch["format"], batch["content"])
        for row in _rows_of(path, fmt, content)
    )
    while part := list(islice(rows, FACTS_AT_ONCE)):
        yield pd.DataFrame(part, columns=["path", "key", "value", "value_type"])


def _arrow_facts(files: DataFrame) -> DataFrame:
    """YAML, XML and JSON texts: one reader for each, so a setting reads alike at any depth."""
    wanted = files.filter(F.col("format").isin("yaml", "xml", "json"))
    return wanted.select("path", "format", "content").mapInPandas(_read_batches, FACT_ROWS)


# --------------------------------------------------------------- public --


def config_facts(files: DataFrame) -> DataFrame:
    """Settings of all files: ``(path, key, value, value_type)``."""
    return _facts_of_known(files.withColumn("format", config_format("path")).filter(F.col("format").isNotNull()))


def _facts_of_known(known: DataFrame) -> DataFrame:
    return _native_facts(known).unionByName(_arrow_facts(known))


def flatten_json(texts: DataFrame) -> DataFrame:
    """Settings of JSON texts given as ``(path, content)`` whatever their names."""
    known = texts.withColumn("format", F.lit("json"))
    return _arrow_facts(known)


def config_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Settings whose value differs: ``(path, key, old_value, new_value, ...)``.

    A missing key equals an explicit null, values compare with their type.
    """

    def side(facts: DataFrame, name: str) -> DataFrame:
        return facts.select(
            "path",
            "key",
            F.col("value").alias(f"{name}_value"),
            F.col("value_type").alias(f"{name}_type"),
            X.comparable(F.col("value"), F.col("value_type")).alias(f"{name}_cmp"),
        )

    return (
        side(old, "old")
        .join(side(new, "new"), ["path", "key"], "full_outer")
        .filter(~F.col("old_cmp").eqNullSafe(F.col("new_cmp")))
        .select("path", "key", "old_value", "old_type", "new_value", "new_type")
    )


def _changed_texts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Configuration files whose texts differ: ``(path, format, old, new)``; a missing file has no text."""
    before, after = (
        files.filter(config_format("path").isNotNull()).select("path", F.col("content").alias(name))
        for files, name in ((old, "old"), (new, "new"))
    )
    both = before.join(after, "path", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", config_format("path").alias("format"), "old", "new")


def _pair_id() -> Column:
    """Digest of a format and two texts, each with its length."""
    parts = [F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit(""))) for c in ("format", "old", "new")]
    return F.sha2(F.concat(*parts), 256)


def _changes_of_pairs(texts: DataFrame) -> DataFrame:
    """Changes by pair of texts, each distinct pair read once: as :func:`config_changes`, with the pair's id as ``path``."""
    pairs = stage(texts.select("format", "old", "new").distinct().select(_pair_id().alias("path"), "*"), "pairs")
    old, new = (_facts_of_known(pairs.select("path", "format", F.col(c).alias("content"))) for c in ("old", "new"))
    return config_changes(old, new)


def distinct_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Settings that differ between two revisions ``(path, content)``, once for all files of equal texts: ``(key, old_value, ...)``.

    What asks for keys and values only needs no path. Files of equal texts
    in both revisions are not read.
    """
    return _changes_of_pairs(_changed_texts(old, new)).drop("path")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`config_changes` of two revisions ``(path, content)``, which reads each distinct pair of differing texts once."""
    texts = stage(_changed_texts(old, new), "changed_texts")
    changes = stage(_changes_of_pairs(texts).withColumnRenamed("path", "pair"), "pair_changes")
    paths = texts.select("path", _pair_id().alias("pair"))
    return paths.join(changes, "pair").select("path", "key", "old_value", "old_type", "new_value", "new_type")


def key_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """All keys of two revisions, per file."""
    return old.select("path", "key").union(new.select("path", "key")).distinct()


def _services_in(documents: list[object]) -> Iterator[str]:
    for doc in documents:
        if not isinstance(doc, dict):
            continue
        metadata = doc.get("metadata", {})
        name = metadata.get("name") if isinstance(metadata, dict) else None
        if isinstance(name, str) and name:
            yield name
        node: object = doc
        for step in ("spec", "template", "spec"):
            node = node.get(step, {}) if isinstance(node, dict) else {}
        containers = node.get("containers", []) if isinstance(node, dict) else []
        for container in containers or []:
            variables = container.get("env", []) if isinstance(container, dict) else []
            for variable in variables or []:
                value = variable.get("value") if isinstance(variable, dict) else None
                host = re.match(HOST_RE, value) if isinstance(value, str) else None
                if host:
                    yield host.group(1)


def _manifest_rows(path: str, content: str | None) -> list[tuple[str, str]]:
    try:
        return [(path, _text(service)) for service in set(_services_in(_yaml_documents(content or "")))]
    except TypeError:  # containers or env of another shape
        return []


def _manifest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (row for b in batches for path, content in zip(b["path"], b["content"]) for row in _manifest_rows(path, content))
    while part := list(islice(rows, FACTS_AT_ONCE)):
        yield pd.DataFrame(part, columns=["path", "service"])


def manifest_services(files: DataFrame) -> DataFrame:
    """Services a YAML manifest names or calls: ``(path, service)``."""
    manifests = files.filter(P.extension("path").isin("yaml", "yml")).select("path", "content")
    return manifests.mapInPandas(_manifest_batches, SERVICE_ROWS)
