"""Problem 2: nested semi-structured records turned into related flat tables.

Method: parse to VARIANT, infer one merged schema over all records, then explode every array level of that schema into a
child table that carries its record, its parent's surrogate key and the array ordinal. The inferred schema decides which
tables there are; named tables with typed columns (``work_tables``) are views over them. Python only walks the records
for the schema, batch by batch (lists of mixed entries have no type in the JVM); tables are made in the JVM. Rows of a child table are keyed by ``path``: the 0-based positions
from the outermost list inwards, joined by ``/``, unique within the record and the child table.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from claimloom.session import cut

#: Field names are schema, not data; payloads with more distinct fields than this are refused with an error.
MAX_FIELDS = 100_000


def _get(v: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f'$["{field}"]' if "'" in field else f"$['{field}']", kind)


def _real(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_list(v: Column) -> Column:
    """The elements of an array; a single value is a list of one; null is no list."""
    return F.when(_real(v), F.coalesce(_items(v), F.array(v)))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _layers(payload: Column, envelope: str) -> Column:
    """At least as many as the wrappings of a record: each opens an envelope, or takes a bracket or quote off the run of
    them with which the payload, or an envelope's content, begins."""
    run = r"[\s\[\"\\]*"
    after = F.regexp_extract_all(payload, F.lit(envelope + r"[\\\"\s]*:(" + run + ")"), F.lit(1))
    return F.length(F.regexp_extract(payload, "^" + run, 0)) + F.size(after) + F.aggregate(F.transform(after, lambda x: F.length(x)), F.lit(0), lambda x, y: x + y) + 1


def parse_records(df: DataFrame, payload: str, envelope: str = "message", out: str = "record") -> DataFrame:
    """``df`` with the VARIANT column ``out``: the record in ``payload``.

    JSON text inside JSON text, ``{envelope: record}`` and lists of one are opened, in any order, however deep. Null, blank,
    truncated or other unreadable payloads give null.
    """

    def opened(v: Column, _: Column) -> Column:
        items, inner = _items(v), _get(v, envelope)
        return (
            F.when(_is_text(v), F.try_parse_json(F.try_variant_get(v, "$", "string")))
            .when(F.size(items) == 1, F.get(items, F.lit(0)))
            .when(_real(inner), inner)
            .otherwise(v)
        )

    # The fold binds the record to a lambda variable at each step; chained columns would repeat it exponentially.
    steps = F.sequence(F.lit(1), F.coalesce(_layers(F.col(payload), envelope), F.lit(1)))
    return df.withColumn(out, F.aggregate(steps, F.try_parse_json(F.col(payload)), opened))


def _named(field: str) -> str:
    """A field's name in a path, where dots part fields."""
    return field.replace("\\", "\\\\").replace(".", "\\.")


def _fields(path: str) -> list[str]:
    return [re.sub(r"\\(.)", r"\1", f) for f in re.findall(r"(?:\\.|[^.\\])+", path)]


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "OBJECT"
    if isinstance(value, list):
        return "ARRAY"
    return "VOID" if value is None else "BOOLEAN" if isinstance(value, bool) else "BIGINT" if isinstance(value, int) else "DOUBLE" if isinstance(value, float) else "STRING"


def record_fields(value: object) -> set[tuple[str, str]]:
    """(path, kind) of every field of a parsed record; of a list, the kind is ARRAY with that of each entry. Array levels add
    nothing to a path, but a list in a list is the field ``[]`` of the outer one."""
    out: set[tuple[str, str]] = set()
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            out.add((path, "OBJECT"))
            todo += [(f"{path}.{_named(k)}" if path else _named(k), x) for k, x in v.items()]
        elif isinstance(v, list):
            out.update((path, f"ARRAY<{_kind(x)}>") for x in v or [None])
            for x in v:
                if isinstance(x, dict):
                    todo += [(f"{path}.{_named(k)}" if path else _named(k), y) for k, y in x.items()]
                elif isinstance(x, list):
                    todo.append((path + "[]", x))
        else:
            out.add((path, _kind(v)))
    return out


def _schema_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        total: Counter[tuple[str, str]] = Counter()
        for text in pdf["record"]:
            total.update(record_fields(json.loads(text)))
        yield pd.DataFrame([(*f, n) for f, n in total.items()], columns=["path", "kind", "records"])


def merged_schema(records: DataFrame, record: str = "record") -> DataFrame:
    """(path, kind, records): every field met anywhere, with every type it takes and how many records hold it so.

    Fields are counted in each batch before the shuffle, which therefore carries schema, not records. Empty input gives no rows.
    """
    texts = records.where(F.col(record).isNotNull()).select(F.to_json(record).alias("record"))
    return texts.mapInPandas(_schema_batches, "path string, kind string, records long").groupBy("path", "kind").agg(F.sum("records").alias("records"))


def array_fields(schema: DataFrame, stated: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Paths that are a list in at least one record, and those of ``stated`` (lists by the format) that occur in any form."""
    rows = schema.where(F.col("path") != "").groupBy("path").agg(F.max(F.col("kind").startswith("ARRAY")).alias("is_list")).limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields: field names seem to hold data")
    # A name with both kinds of quotes can't be asked for.
    return sorted(r["path"] for r in rows if not r["path"].startswith("[]") and not ("'" in r["path"] and '"' in r["path"]) and (r["is_list"] or r["path"] in stated))


def _depth(path: str) -> tuple[int, str]:
    return len(_fields(path)) + path.count("[]"), path


def child_tables(records: DataFrame, key: str, array_paths: list[str], record: str = "record", texts: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """For each array path a child table (key, path, parent, ordinal, value), null entries left out.

    ``parent`` is the path of the row of the nearest enclosing array (null: the record itself). A single value
    where other records have a list is a list of one; where they have lists of lists (``x[]`` is an array path), a list without
    lists is one entry. Null entries keep their position and give no row. ``texts``: for a path, the pattern of a text that
    stands for an entry of it; a text in place of the object that should hold the path is its only entry.
    """
    root = records.select(F.col(key).alias(key), F.lit(None).cast("string").alias("path"), F.col(record).alias("value"))
    tables: dict[str, DataFrame] = {}
    for path in sorted(array_paths, key=_depth):
        above = max((p for p in tables if path.startswith((p + ".", p + "[]"))), key=len, default=None)
        base = tables[above].select(key, "path", "value") if above else root
        v, outer = F.col("value"), None
        for field in _fields(path[len(above or "") :].removeprefix("[]")):
            outer, v = v, _get(v, field)
        if texts and path in texts and outer is not None:
            v = F.coalesce(v, F.when(_is_text(outer), outer))
        rows = base.select(key, F.col("path").alias("parent"), v.alias("list"))
        entries = as_list(F.col("list"))
        if path + "[]" in array_paths:
            stands = (lambda x: _is_text(x) & F.try_variant_get(x, "$", "string").rlike(texts[path])) if texts and path in texts else (lambda x: F.lit(False))
            nested = F.exists(_items(F.col("list")), lambda x: _items(x).isNotNull() | stands(x))
            entries = F.when(_real(F.col("list")), F.when(nested, _items(F.col("list"))).otherwise(F.array("list")))
        rows = rows.select(key, "parent", F.posexplode(entries).alias("ordinal", "value"))
        tables[path] = rows.where(_real(F.col("value"))).select(key, F.concat_ws("/", "parent", F.col("ordinal").cast("string")).alias("path"), "parent", "ordinal", "value")
    return tables


def flat_tables(records: DataFrame, key: str, stated: list[str] | tuple[str, ...] = (), texts: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A child table for every list of the merged schema of ``records`` (key, record): ``child_tables`` of ``array_fields``."""
    return child_tables(records, key, array_fields(merged_schema(records), stated), texts=texts)


# -- works of a bibliographic registry ---------------------------------------------------------------------------

#: What is a list by the format of a registry's works, even if a given batch has single values only.
WORK_LISTS = ["author", "author.affiliation", "author.affiliation.id", "link", "published.date-parts", "published.date-parts[]", "update-to"]
#: A text that is a date stands for a list of its parts.
DATE_TEXTS = {"published.date-parts": r"^\s*\d{4}-"}


def _text(v: Column, *fields: str) -> Column:
    """A named text field; a plain string stands for the value itself."""
    got = [F.try_variant_get(v, f"$['{f}']", "string") for f in fields]
    return F.nullif(F.trim(F.coalesce(*got, F.when(_is_text(v), F.try_variant_get(v, "$", "string")))), F.lit(""))


def _records(df: DataFrame, key: str, payload: str) -> DataFrame:
    # Parsed once: the schema and every child table read the checkpoint instead of the text.
    return cut(parse_records(df.select(key, payload), payload).select(key, "record")).where(F.col("record").isNotNull())


def _lists(df: DataFrame, key: str, payload: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    records = _records(df, key, payload)
    found = array_fields(merged_schema(records), [*WORK_LISTS, "published"])
    if "published" in found:  # a date may be a bare text: then the schema has no list below
        found = sorted({*found, "published.date-parts", "published.date-parts[]"} - {"published"})
    return records, child_tables(records, key, found, texts=DATE_TEXTS)


def list_tables(df: DataFrame, key: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """A flat table (key, path, parent, ordinal, value) for every list that the works hold, whatever its name."""
    return _lists(df, key, payload)[1]


def list_rows(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """(key, child, path, parent, ordinal): one row per row of ``list_tables``; no row if there is no list."""
    columns = [F.col(key).cast("long").alias(key), F.lit("").alias("child"), "path", "parent", "ordinal"]
    records, tables = _lists(df, key, payload)
    out = records.where("false").select(columns[0], columns[1], *[F.lit(None).cast(k).alias(c) for c, k in (("path", "string"), ("parent", "string"), ("ordinal", "int"))])
    for name, t in tables.items():
        out = out.unionByName(t.select(columns[0], F.lit(name).alias("child"), *columns[2:]))
    return out


def work_tables(df: DataFrame, key: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """The flat tables ``author``, ``affiliation``, ``affiliation_id``, ``published``, ``link``, ``update``: typed columns over
    ``list_tables``. A list that the schema doesn't have is an empty table.

    Null and unreadable payloads give no rows, nor do dates without a year and links without a URL. Repeated
    records give their rows again, under their own key.
    """
    records, lists = _lists(df, key, payload)
    none = records.where("false").select(key, F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("ordinal"), F.col("record").alias("value"))
    t = lambda path: lists.get(path, none)
    v = F.col("value")
    keys = [key, "path", "parent", "ordinal"]
    date = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.when(_is_text(v), F.split(F.trim(F.try_variant_get(v, "$", "string")), "[-/]")))
    number = lambda i: F.get(date, F.lit(i)).try_cast("int")
    return {
        "author": t("author").select(*keys, _text(v, "name").alias("name"), _get(v, "given", "string").alias("given"), _get(v, "family", "string").alias("family"), _get(v, "sequence", "string").alias("sequence"), _get(v, "ORCID", "string").alias("orcid")),
        "affiliation": t("author.affiliation").select(*keys, _text(v, "name").alias("name")),
        "affiliation_id": t("author.affiliation.id").select(*keys, _text(v, "id").alias("id"), _get(v, "id-type", "string").alias("id_type")),
        "link": t("link").select(*keys, _text(v, "URL").alias("url"), _get(v, "content-type", "string").alias("content_type"), _get(v, "intended-application", "string").alias("application")).where("url is not null"),
        "update": t("update-to").select(*keys, _text(v, "DOI").alias("doi"), _get(v, "type", "string").alias("type"), _get(v, "label", "string").alias("label")),
        "published": t("published.date-parts").select(*keys, number(0).alias("year"), number(1).alias("month"), number(2).alias("day")).where("year is not null"),
    }


def work_rows(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """(key, child, path): one row per row of ``work_tables``."""
    parts = [t.select(F.col(key).cast("long").alias(key), F.lit(name).alias("child"), "path") for name, t in work_tables(df, key, payload).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
