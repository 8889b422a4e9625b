"""What readers see of payloads, interpretations and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.text import squash

# Fixed values.
SURFACE_KEYS = ("best_guess_kind", "summary", "entities", "salient_facts", "language", "confidence", "source_attribution")


def field(payload: Column, name: str) -> Column:
    """A top-level string of a JSON payload, empty as null."""
    return F.nullif(F.get_json_object(payload, f"$.{name}"), F.lit(""))


def first_of(payload: Column, *names: str) -> Column:
    return F.coalesce(*[field(payload, n) for n in names])


def payload_summary(payload: Column, text_cap: int = 500, context_cap: int = 500) -> Column:
    """(content_type, text, context, truncated) by content type."""
    text = F.get_json_object(payload, "$.text")
    kind = F.get_json_object(payload, "$.content_type")
    cut = (kind == "text") & (F.length(text) > text_cap)
    return F.struct(kind.alias("content_type"), F.left(text, F.lit(text_cap)).alias("text"), F.left(F.get_json_object(payload, "$.context"), F.lit(context_cap)).alias("context"), F.coalesce(cut, F.lit(False)).alias("truncated"))


def interpretation_summary(extraction: Column) -> Column:
    """A map of the surface keys that say something."""
    entries = [F.struct(F.lit(k).alias("key"), F.get_json_object(extraction, f"$.{k}").alias("value")) for k in SURFACE_KEYS]
    said = lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]", "{}", "false", "0", "null")
    return F.map_from_entries(F.filter(F.array(*entries), said))


def validate_extraction(extraction: Column) -> Column:
    """Null if it holds, else what is wrong."""
    parsed = F.get_json_object(extraction, "$")
    missing = lambda k: F.get_json_object(extraction, f"$.{k}").isNull()
    return F.when(parsed.isNull(), "not an object").when(missing("best_guess_kind"), "best_guess_kind is missing").when(missing("summary"), "summary is missing")


def preview(payload: Column, most: int = 320) -> Column:
    return F.left(squash(first_of(payload, "text", "context", "result")), F.lit(most))


def why_durable(salience: Column, components: Column, temporal_class: Column, surprise: Column) -> Column:
    """A line on salience, its two largest components, temporal class and surprise; parts that are unknown are left out."""
    top = F.slice(F.sort_array(F.transform(F.filter(F.map_entries(components), lambda e: e["value"] > 0), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))), asc=False), 1, 2)
    named = F.array_join(F.transform(top, lambda e: F.concat(e["k"], F.lit(" "), F.format_number(e["v"], 2))), ", ")
    return F.nullif(F.concat_ws("; ", F.concat(F.lit("salience "), F.format_number(salience, 2)), F.nullif(named, F.lit("")), F.concat(F.lit("class "), temporal_class), F.concat(F.lit("surprise "), F.format_number(surprise, 2))), F.lit(""))


def evidence_line(predicate: Column, confidence: Column, corroborating: Column, conflicted: Column) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("edge "), predicate), F.concat(F.lit("confidence "), F.format_number(confidence, 2)), F.when(corroborating > 0, F.concat(corroborating.cast("string"), F.lit(" further sources"))).otherwise("no further source"), F.when(conflicted, "its source is in conflict"))


def key_points(points: Column, hashes: Column, most: int = 8) -> Column:
    """Points (text, mode, sources: places from 1) with their sources' hashes; points without a source that exists go."""
    cited = lambda p: F.array_distinct(F.filter(F.transform(p["sources"], lambda i: F.get(hashes, i - 1)), lambda h: h.isNotNull()))
    made = F.transform(points, lambda p: F.struct(squash(p["text"]).alias("text"), F.coalesce(p["mode"], F.lit("fact")).alias("mode"), cited(p).alias("citations")))
    return F.slice(F.filter(made, lambda p: (F.size(p["citations"]) > 0) & (p["text"] != "")), 1, most)


def string_list(raw: Column, most: int) -> Column:
    return F.slice(F.filter(F.transform(raw, lambda x: squash(x)), lambda x: x != ""), 1, most)


def flatten_parts(parts: Column) -> Column:
    """label: text lines of a compound payload's parts (label, text)."""
    return F.array_join(F.transform(F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != ""), lambda p: F.concat_ws(": ", F.nullif(p["label"], F.lit("")), p["text"])), "\n")


def parse_json_loose(raw: Column) -> Column:
    """The object in a model's answer: the whole, a fenced block, or from the first brace to the last; null if none parses."""
    valid = lambda c: F.when(F.get_json_object(c, "$").startswith("{"), F.get_json_object(c, "$"))
    return F.coalesce(valid(F.trim(raw)), valid(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), valid(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)))


def sanitize_actor(raw: Column) -> Column:
    s = F.regexp_replace(F.translate(raw, "\t\r\n", "   "), r"\p{Cntrl}", "")
    return F.nullif(F.left(F.trim(s), F.lit(120)), F.lit(""))


def wrap_untrusted(content: Column) -> Column:
    return F.concat(F.lit("<untrusted>\n"), F.replace(content, F.lit("</untrusted>"), F.lit("&lt;/untrusted&gt;")), F.lit("\n</untrusted>"))


def capped(text: Column, most: int) -> Column:
    """(short, full): the text cut to most characters, and the whole of it if it was cut."""
    return F.struct(F.left(text, F.lit(most)).alias("short"), F.when(F.length(text) > most, text).alias("full"))


def clean_model_text(text: Column) -> Column:
    return squash(F.regexp_replace(text, "[‒–—―]", "-"))


def clamp_time(text: Column, now: Column) -> Column:
    """A time in ISO form, UTC if it names no zone, no later than now; null if it can't be read."""
    return F.least(F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))), now)


def rrule_freq(rule: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(rule), "FREQ=([^;]+)", 1), F.lit(""))


def next_monthly(anchor: Column, now: Column, months: int = 1, most: int = 2400) -> Column:
    """The first of anchor, anchor + months, ... that is not before now; a day that a month lacks is clamped and stays so."""
    steps = F.greatest(F.lit(0), F.ceil(F.months_between(now, anchor) / months).cast("int"))
    walk = F.aggregate(F.sequence(F.lit(1), F.least(steps + 1, F.lit(most))), anchor, lambda d, _: F.when(d < now, F.add_months(d, F.lit(months))).otherwise(d))
    return F.when(anchor >= now, anchor).otherwise(walk)


# Caps of an extraction's surface.
SUMMARY_CHARS, FACTS, FACT_CHARS, ENTITIES, RELATIONS = 400, 10, 300, 20, 20
COMPACT_SUMMARY, COMPACT_ENTITIES, COMPACT_EDGES = 280, 5, 5


def cap_extraction(extraction: Column) -> Column:
    """An extraction struct (summary, salient_facts, entities, relations, ...) within its caps; other fields stay."""
    return (
        extraction.withField("summary", F.left(extraction["summary"], F.lit(SUMMARY_CHARS)))
        .withField("salient_facts", F.transform(F.slice(extraction["salient_facts"], 1, FACTS), lambda x: F.left(x, F.lit(FACT_CHARS))))
        .withField("entities", F.slice(extraction["entities"], 1, ENTITIES))
        .withField("relations", F.slice(extraction["relations"], 1, RELATIONS))
    )


def enriched_text(base: Column, extracted: Column, summary: Column, facts: Column) -> Column:
    """The searchable text once an event is understood: its own, what was extracted, the summary, the facts, a line each."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n", some(base), some(extracted), some(summary), F.filter(facts, lambda x: F.trim(x) != ""))


def embedding_text(payload: Column, extraction: Column, entity_names: Column) -> Column:
    """What an event is embedded by; `(empty event)` where nothing is there."""
    parts = [field(payload, n) for n in ("text", "context", "filename_hint", "action", "subject", "result")]
    more = [field(extraction, n) for n in ("extracted_text", "summary")]
    names = F.nullif(F.array_join(entity_names, ", "), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("\n", *parts, *more, names), F.lit("")), F.lit("(empty event)"))


def binary_payload(content: Column, mime: Column, filename_hint: Column, context: Column, type_hint: Column) -> Column:
    """The payload of binary content, which is always a reference to a blob."""
    parts = {"content_type": F.lit("binary"), "blob_hash": F.concat(F.lit("sha256:"), F.sha2(content, 256)), "mime": mime, "size_bytes": F.octet_length(content), "filename_hint": filename_hint, "context": context, "type_hint": type_hint}
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def shape(extraction: Column, entities: Column, edges: Column, surprise: Column, temporal_class: Column, compact: bool = True) -> Column:
    """JSON of what a hit shows of its interpretation; null parts are left out, and nulls of an edge's validity too.

    Compact: kind, a short summary, few entities and edges. Else the surface keys, raw entities only where no canonical ones are known.
    """
    kind, summary = field(extraction, "best_guess_kind"), field(extraction, "summary")
    none = lambda a: F.when(F.size(a) > 0, a)
    if compact:
        parts = [kind.alias("best_guess_kind"), F.left(summary, F.lit(COMPACT_SUMMARY)).alias("summary"), none(F.slice(entities, 1, COMPACT_ENTITIES)).alias("canonical_entities"), none(F.slice(edges, 1, COMPACT_EDGES)).alias("entity_edges")]
    else:
        raw = F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, F.get_json_object(extraction, "$.entities"))
        parts = [kind.alias("best_guess_kind"), summary.alias("summary"), raw.alias("entities"), F.get_json_object(extraction, "$.salient_facts").alias("salient_facts"), none(entities).alias("canonical_entities"), none(edges).alias("entity_edges")]
    return F.nullif(F.to_json(F.struct(*parts, surprise.alias("surprise_score"), temporal_class.alias("temporal_class"))), F.lit("{}"))
