"""Deeply nested records turned into related flat tables.

One depth-first visit of each record emits (tag, key, parent key, payload) rows;
all child tables come out of the same pass. Rows are then split by tag and each
tag's schema is applied to its payload. Raw JSON and typed tables take one path:
typed rows are rendered as JSON in the JVM first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centime.session import durable

# The members that hold the items of a delivered file, and registry names of the typed tables.
CONTAINERS = ("items", "source_arithmetic_notices", "groups")
REGISTRIES = {"source_reconciliation": "source-reconciliation", "delivery_check": "delivery-check", "action_groups": "actions-p174"}

#: Where child records lie: member of the item -> tag of the table; members of a child likewise.
CHILDREN = {
    "comparisons": "comparison",
    "supporting_documents": "document",
    "evidence": "evidence",
    "parent": "parent",
    "parents": "parent",
    "actions": "action",
}
NESTED = {"action": {"subactions": "subaction"}}

#: Schemas applied by tag. Numbers stay text where sources differ in type; cast with try_cast.
SCHEMAS = {
    "item": "stage string, measure string, budget string, mission string, program string, status string, explanation string, source_id string, source_sha string",
    "comparison": "source_id string, source_sha string, url string, table_index string, balance_row_index string, stage string, edition string, values_cents map<string,string>, gap_cents string",
    "document": "id string, title string, url string, path string, sha256 string, status string, page_number string",
    "evidence": "id string, title string, url string, path string, sha256 string, status string, page_number string",
    "parent": "year string, stage string, measure string, budget string, mission string, mission_label string, program string, program_label string, action string, action_label string, subaction string, subaction_label string, category string, title string, cents string, source string, line string, field string, approximate string",
    "action": "code string, label string, euros string, cents string, page string",
    "subaction": "code string, label string, euros string, cents string, page string",
}

TAGGED = "tag string, registry string, record_id bigint, item_no int, field string, child_no int, parent_tag string, parent_no int, payload string"


def _strict(_: str) -> None:
    raise ValueError("not JSON")


def items_of(document: object) -> list:
    """The items of one delivered file: a bare array, a container member, or the file itself as the one item."""
    if isinstance(document, list):
        return document
    if isinstance(document, dict):
        for name in CONTAINERS:
            if name in document:
                held = document[name]
                return held if isinstance(held, list) else [] if held is None else [held]
        return [document]
    return []


def visit(item: dict, wanted: frozenset[str]) -> Iterator[tuple]:
    """Depth first: (tag, field, child_no, parent_tag, parent_no, payload) of an item and everything below it."""
    if "item" in wanted:
        yield "item", None, 0, None, None, {k: v for k, v in item.items() if k not in CHILDREN}

    def below(held: object, field: str, tag: str, parent_tag: str, parent_no: int) -> Iterator[tuple]:
        nested = NESTED.get(tag, {})
        for no, child in enumerate(held if isinstance(held, list) else [held]):
            if not isinstance(child, dict):
                continue
            if tag in wanted:
                yield tag, field, no, parent_tag, parent_no, {k: v for k, v in child.items() if k not in nested} if nested else child
            for name, inner in nested.items():
                if child.get(name) is not None:
                    yield from below(child[name], name, inner, tag, no)

    for field, tag in CHILDREN.items():
        held = item.get(field)
        if held is not None:
            yield from below(held, field, tag, "item", 0)


def _emitter(wanted: frozenset[str]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("tag", pa.string()), ("registry", pa.string()), ("record_id", pa.int64()), ("item_no", pa.int32()), ("field", pa.string())]
            + [("child_no", pa.int32()), ("parent_tag", pa.string()), ("parent_no", pa.int32()), ("payload", pa.string())]
        )
        for batch in batches:
            out: list[tuple] = []
            for registry, record, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    document = json.loads(payload, parse_constant=_strict)
                except (ValueError, RecursionError):
                    continue
                for no, item in enumerate(items_of(document)):
                    if isinstance(item, dict):
                        for tag, field, child, parent_tag, parent_no, body in visit(item, wanted):
                            out.append((tag, registry, record, no, field, child, parent_tag, parent_no, json.dumps(body, ensure_ascii=False)))
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return emit


def as_payloads(typed: DataFrame, registry: str, tags: frozenset[str]) -> DataFrame:
    """A typed table as (registry, record_id, payload): only members that lead to the tags are read, nulls are kept."""
    fields = [c for c in typed.columns if (c in CHILDREN and ({CHILDREN[c], *NESTED.get(CHILDREN[c], {}).values()} & tags)) or ("item" in tags and c not in CHILDREN and c != "record_id")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
    return typed.select(F.lit(registry).alias("registry"), "record_id", body.alias("payload"))


def flatten(raw: DataFrame | None = None, tags: tuple[str, ...] = tuple(SCHEMAS), **typed: DataFrame) -> DataFrame:
    """One tagged table of every record below the given tables, emitted in a single pass.

    raw has registry, record_id, payload (JSON text); typed tables are named as in
    REGISTRIES. Columns: tag, registry, record_id, item_no (place of the item in
    its payload from 0; 0 in typed tables), field, child_no (place in the array as
    delivered, null elements counted; 0 for a single object), parent_tag,
    parent_no, payload. Null, empty and broken payloads give no row; elements that
    are no objects give none but keep their place. Repeated records repeat. Extra
    columns of the tables and extra members of the records do no harm.
    """
    wanted = frozenset(tags)
    parts = [as_payloads(df, REGISTRIES[name], wanted) for name, df in typed.items()]
    if raw is not None:
        parts.append(raw.select("registry", "record_id", "payload"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where(F.col("payload").isNotNull()).mapInArrow(_emitter(wanted), TAGGED)


def table_of(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table: the keys, and the tag's schema applied to the payload; a member named as a key gets the tag before its name."""
    keys = ["registry", "record_id", "item_no", "field", "child_no", "parent_tag", "parent_no"]
    body = tagged.where(F.col("tag") == tag).withColumn("row", F.from_json("payload", SCHEMAS[tag]))
    members = body.schema["row"].dataType.names
    return body.select(*keys, *(F.col("row")[m].alias(f"{tag}_{m}" if m in keys else m) for m in members))


def write_tables(tagged: DataFrame, path: str) -> None:
    """The tagged rows as one dataset partitioned by tag; each partition is then read with its own schema."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def is_number(text: Column) -> Column:
    """Whether a text is a plain number (surrounding blanks allowed)."""
    return text.rlike(r"^\s*[-+]?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?\s*$")


def amounts_titles_labels(raw: DataFrame, **typed: DataFrame) -> DataFrame:
    """(registry, record_id, item_no, child_no) of children that carry their key value.

    A comparison with a number in values_cents.RECETTES (0 and numbers as text
    count), a supporting document with a title that is not blank, a parent with a
    program_label that is not empty. Distinct. All tags come from one pass, written
    partitioned by tag; each tag is then read alone, with its schema.
    """
    tagged = durable(flatten(raw, tags=("comparison", "document", "parent"), **typed), "tagged", by=["tag"])
    keys = ["registry", "record_id", "item_no", "child_no"]
    value = F.try_element_at("values_cents", F.lit("RECETTES"))
    found = [
        table_of(tagged, tag).where(carries).select(*keys)
        for tag, carries in (
            ("comparison", value.isNotNull() & is_number(value)),
            ("document", F.col("title").rlike(r"(?U)\S")),
            ("parent", F.col("program_label") != ""),
        )
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()
