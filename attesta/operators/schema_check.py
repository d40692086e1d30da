"""Artifacts held against a schema document, value by value.

The document names the fields of each kind of object in words: ``string``,
``integer``, ``object`` (free keys), ``one of a b c``, or another kind; before
it ``required``, ``optional`` (null allowed) and ``list of``.  A walk goes from
the root down: a value that breaks its rule becomes a row, containers hand on
those of their values that break a rule or are containers themselves, so no
sound text is carried along.  Nothing is shuffled before the rows per paper.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fv
from attesta.operators.audit import _finding
from attesta.session import cut_lineage, discard

STEPS = 6  # levels between two tables; artifacts are a few levels deep, traces any number
SCALARS = ("string", "integer", "object", "one")
WHOLE = r"^\s*[-+]?\d+(\.0*)?\s*$"
RULE = "struct<type:string,many:boolean,nullable:boolean,allowed:array<string>,nested:boolean>"


@dataclass(frozen=True)
class Rule:
    kind: str
    field: str
    type: str
    many: bool
    nullable: bool
    required: bool
    allowed: tuple[str, ...] | None


def rules_of(schema: dict[str, dict[str, str]]) -> list[Rule]:
    """The fields of a schema document, one rule each."""
    rules = []
    for kind, fields in schema.items():
        for field, spec in fields.items():
            words = spec.split()
            required, nullable = words[0] == "required", words[0] == "optional"
            words = words[1:] if required or nullable else words
            many = words[:2] == ["list", "of"]
            words = words[2:] if many else words
            allowed = tuple(words[2:]) if words[:2] == ["one", "of"] else None
            if words[0] not in SCALARS and words[0] not in schema:
                raise ValueError(f"{kind}.{field}: {words[0]} is no type and no kind of the schema")
            rules.append(Rule(kind, field, words[0], many, nullable, required, allowed))
    return rules


def _shape(name: Column) -> Column:
    """What a value is, by the name of its variant type: missing, null, string, boolean, integer, number, array or object."""
    return (F.when(name.isNull(), "missing").when(name == "VOID", "null").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(F.startswith(name, F.lit("ARRAY")), "array")
            .when(F.startswith(name, F.lit("OBJECT")), "object").when(name == "BIGINT", "integer").otherwise("number"))


def _fault(row: Column) -> Column:
    """missing, type or enum; null for a value that keeps its rule."""
    rule, shape, as_list = row["rule"], row["found"], row["rule"]["many"] & ~row["listed"]
    text = F.try_variant_get(row["value"], "$", "string")
    whole = shape.isin("integer", "boolean") | (shape.isin("number", "string") & F.coalesce(text.rlike(WHOLE), F.lit(False)))
    fits = (F.when(as_list, shape == "array").when(rule["type"] == "string", shape == "string")
            .when(rule["type"] == "integer", whole).when(rule["type"] == "one", F.lit(True)).otherwise(shape == "object"))
    chosen = (shape == "string") & F.coalesce(F.array_contains(rule["allowed"], text), F.lit(False))
    return (F.when(shape == "missing", "missing").when((shape == "null") & rule["nullable"] & ~row["listed"], F.lit(None))
            .when(~fits, "type").when((rule["type"] == "one") & ~as_list & ~chosen, "enum"))


def _goes_on(row: Column) -> Column:
    """Broken rows, lists that are to be walked, and objects of a kind."""
    return row["fault"].isNotNull() | ((row["found"] != "null") & (row["rule"]["nested"] | (row["rule"]["many"] & ~row["listed"])))


def _judged(entries: Column) -> Column:
    """Entries (path, rule, listed, value) as rows, those alone that go on; one pass each for type, shape and fault."""
    carried = lambda e: [e[c].alias(c) for c in ("path", "rule", "listed", "value")]
    named = F.transform(entries, lambda e: F.struct(*carried(e), F.schema_of_variant(e["value"]).alias("name")))
    shaped = F.transform(named, lambda e: F.struct(*carried(e), _shape(e["name"]).alias("found")))
    rows = F.transform(shaped, lambda e: F.struct(*carried(e), e["found"].alias("found"), _fault(e).alias("fault")))
    return F.filter(rows, _goes_on)


class _Compiled:
    """A schema document as two literals: the rules of each kind by field, and the fields it requires."""

    def __init__(self, rules: list[Rule], root: str):
        kinds = dict.fromkeys([root, *(r.kind for r in rules)])
        as_dict = lambda r: {"type": r.type, "many": r.many, "nullable": r.nullable, "allowed": list(r.allowed or ()),
                             "nested": r.type not in SCALARS}
        named = {k: {r.field: as_dict(r) for r in rules if r.kind == k} for k in kinds}
        self.fields = F.from_json(F.lit(json.dumps(named)), f"map<string,map<string,{RULE}>>")
        self.required = F.from_json(F.lit(json.dumps({k: [r.field for r in rules if r.kind == k and r.required] for k in kinds})),
                                    "map<string,array<string>>")
        self.top = F.from_json(F.lit(json.dumps(as_dict(Rule("", "", root, False, False, True, None)))), RULE)

    def step(self, rows: DataFrame) -> DataFrame:
        """Broken rows as they are; every other row is replaced by its values that go on."""
        rows = rows.withColumns({
            "_fields": F.try_element_at(self.fields, F.col("rule.type")), "_required": F.try_element_at(self.required, F.col("rule.type")),
            "_held": F.try_variant_get("value", "$", "map<string,variant>")})
        entry = lambda path, rule, listed, value: F.struct(
            path.alias("path"), rule.alias("rule"), F.lit(listed).alias("listed"), value.alias("value"))
        place = lambda name: F.concat("path", F.lit("."), name)
        items = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v, i: entry(
            F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), F.col("rule"), True, v))
        known = F.filter(F.map_entries("_held"), lambda e: F.array_contains(F.map_keys("_fields"), e["key"]))
        present = F.transform(known, lambda e: entry(place(e["key"]), F.try_element_at(F.col("_fields"), e["key"]), False, e["value"]))
        absent = F.transform(F.array_except("_required", F.map_keys("_held")), lambda name: entry(
            place(name), F.try_element_at(F.col("_fields"), name), False, F.lit(None).cast("variant")))
        below = _judged(F.when(F.col("rule.many") & ~F.col("listed"), items).otherwise(F.concat(present, absent)))
        itself = F.array(F.struct("path", "rule", "listed", "value", "found", "fault"))
        following = F.when(F.col("fault").isNotNull(), itself).otherwise(below)
        return rows.select("paper_id", F.explode(following).alias("_r")).select("paper_id", "_r.*")


def schema_violations(raw: DataFrame, schema: dict[str, dict[str, str]] = fv.ARTIFACT_SCHEMA, root: str = "Artifact") -> DataFrame:
    """(paper_id, path, fault, expected, found): every value that breaks the schema document.

    ``raw``: paper_id, body.  ``fault`` is missing (a required field is absent),
    type, or enum.  A value of a wrong type is not looked into.  Fields that
    the document does not name are ignored.  As in lenient readers, a boolean
    and a text that spells a whole number pass as integers.  Bodies that are
    null, no JSON, or no object give no rows (see ``invalid_json``); rows that
    repeat a paper are walked one by one.
    """
    made = _Compiled(rules_of(schema), root)
    objects = raw.select("paper_id", F.try_parse_json("body").alias("value")).where(
        F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")))
    rows = objects.select("paper_id", F.lit("$").alias("path"), made.top.alias("rule"), F.lit(False).alias("listed"), "value",
                          F.lit("object").alias("found"), F.lit(None).cast("string").alias("fault"))
    found, earlier = [], None
    while True:
        for _ in range(STEPS):
            rows = made.step(rows)
        table = cut_lineage(rows)
        if earlier is not None:
            discard(earlier)
        broken = table.where("fault IS NOT NULL")
        open_rows = table.where("fault IS NULL")
        found.append(broken.select(
            "paper_id", "path", "fault",
            F.concat(F.when(F.col("rule.many") & ~F.col("listed"), "list of ").otherwise(""), "rule.type").alias("expected"), "found"))
        if open_rows.isEmpty():
            break
        found[-1] = cut_lineage(found[-1])
        earlier, rows = table, open_rows
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def schema_outcome(raw: DataFrame, schema: dict[str, dict[str, str]] = fv.ARTIFACT_SCHEMA, root: str = "Artifact",
                   layers: tuple[str, ...] = fv.ARTIFACT_LAYERS, defaults: tuple[str, ...] = ("metadata", "ara_version")) -> DataFrame:
    """One row per JSON object: n_violations, no_layer, severity (null if it fits), and whether later checks can use it.

    An artifact that breaks the schema is tried again with ``defaults`` filled in
    at the top; it is usable when nothing else is broken and no layer is missing.
    ``paper_id`` is unique in ``raw``.
    """
    gone = F.array_except(F.array(*[F.lit(layer) for layer in layers]), F.json_object_keys("body"))
    objects = raw.where(F.startswith(F.schema_of_variant(F.try_parse_json("body")), F.lit("OBJECT"))).select(
        "paper_id", (F.size(gone) > 0).alias("no_layer"))
    mended = (F.col("fault") == "missing") & F.col("path").isin(*[f"$.{key}" for key in defaults])
    counts = schema_violations(raw, schema, root).groupBy("paper_id").agg(
        F.count("*").alias("n_violations"), F.count_if(~mended).alias("_left"))
    both = objects.join(counts, "paper_id", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    return both.select(
        "paper_id", "n_violations", "no_layer",
        F.when(F.col("n_violations") > 0, F.when(F.col("no_layer"), "blocker").otherwise("critical")).alias("severity"),
        ((F.col("n_violations") == 0) | (~F.col("no_layer") & (F.coalesce("_left", F.lit(0)) == 0))).alias("usable"))


def schema_findings(raw: DataFrame, **choices) -> DataFrame:
    """The one schema finding of each artifact that does not fit."""
    bad = schema_outcome(raw, **choices).where(F.col("severity").isNotNull())
    return _finding(bad, "structural", "artifact", F.lit(None), "schema_validation_failed", F.col("severity"), F.col("n_violations"))
