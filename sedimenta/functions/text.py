"""Text predicates and projections, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Predicates that are no durable relation, and auxiliaries stripped before the test.
NON_DURABLE = (
    "await", "awaits", "awaiting", "contrast", "contrasts", "differ", "differs", "compare", "compares", "compared", "resemble", "resembles",
    "similar to", "relate", "relates", "related to", "associated with", "linked to", "connected to", "mention", "mentions", "mentioned",
    "reference", "references", "referenced", "refers to", "discuss", "discusses", "discussed", "criticize", "criticizes", "criticized",
    "regarding", "about", "seems", "appears to", "may be", "might be",
)
AUXILIARIES = ("is", "was", "are", "were", "has", "have", "had", "been", "being", "will", "would")
# Name shapes.
TICKET = r"^[A-Z][A-Z0-9]*-\d+$"
PATH = r"^(?:/|\./|\.\./)[^\s]+$|^[\w.-]+(?:/[\w.-]+)+$"
FILENAME = r"^[\w-]+(?:\.[\w-]+)*\.[A-Za-z0-9]{1,6}$"
DOMAIN_SUFFIX = r"(?i)\.(team|me|com|ai|io|app|dev|net|org|co|xyz|de|ch|eu)$"
DOMAIN = r"(?i)\b[\w-]+\.(team|me|com|ai|io|app|dev|net|org|co|xyz|de|ch|eu)\b"
CITATION_YEAR = r"\b(?:19|20)\d{2}\b"
TEMPORAL_INTENT = r"(?i)\b(current|currently|latest|now|today|recent|recently|nowadays|present|these days|right now|as of)\b"
SLUG = r"^[a-z][a-z0-9_]{1,30}$"
ULID = r"(?i)^[0-9A-HJKMNP-TV-Z]{26}$"
# Verdicts and their older names.
VERDICTS = ("updates", "reverts", "evolves", "conflicts", "false_conflict", "confirms", "unrelated", "name_clash", "unsure")
VERDICT_ALIASES = {
    "contradicts": "conflicts", "compatible": "unrelated", "unclear": "unsure", "temporal_supersession": "updates", "temporal_regression": "reverts",
    "temporal_evolution": "evolves", "contradiction": "conflicts", "negation_artifact": "false_conflict", "corroboration": "confirms",
    "no_relation": "unrelated", "different_referent": "name_clash", "uncertain": "unsure",
}
CONFLICT_FLOOR = 0.7
# Hints that raise salience.
HIGH_SIGNAL = ("decision", "preference", "fact", "constitution", "principle", "rule", "deadline", "commitment", "promise", "complaint", "concern", "insight", "discovery")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def fold_accents(text: Column) -> Column:
    """Accents off, by ICU decomposition; runs in the JVM."""
    return F.regexp_replace(F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(False)), r"\p{M}", "")


def squash(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm(text: Column) -> Column:
    return squash(F.lower(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def predicate_is_crisp(predicate: Column) -> Column:
    """One to four words."""
    return word_count(predicate).between(1, 4)


def predicate_is_durable(predicate: Column) -> Column:
    """False for a stem of NON_DURABLE or a phrase that begins with one, leading auxiliaries aside; an empty predicate is durable."""
    text = F.regexp_replace(norm(predicate), "^(?:(?:" + "|".join(AUXILIARIES) + ") )+", "")
    stem = text.rlike("^(?:" + "|".join(NON_DURABLE) + ")(?: |$)")
    return ~stem


def is_structural_name(name: Column) -> Column:
    """Ticket ids, paths, and file names that don't end in a domain suffix."""
    name = F.trim(name)
    return (name != "") & (name.rlike(TICKET) | name.rlike(PATH) | (name.rlike(FILENAME) & ~name.rlike(DOMAIN_SUFFIX)))


def type_mismatch(name: Column, kind: Column) -> Column:
    """(from, to, confidence) where a person's name has a domain or a citation year, else null."""
    make = lambda to, c: F.struct(kind.alias("from_kind"), F.lit(to).alias("to_kind"), F.lit(c).alias("confidence"))
    return F.when((kind == "person") & name.rlike(DOMAIN), make("product", 0.9)).when((kind == "person") & name.rlike(CITATION_YEAR), make("concept", 0.8))


def has_temporal_intent(query: Column) -> Column:
    return query.rlike(TEMPORAL_INTENT)


def route_depth(query: Column) -> Column:
    """shallow for empty queries, identifiers and single tokens, else normal."""
    q = F.trim(F.coalesce(query, F.lit("")))
    identifier = q.startswith("sha256:") | q.startswith("http://") | q.startswith("https://") | q.startswith("file://") | q.rlike(ULID)
    return F.when((q == "") | identifier | (word_count(F.regexp_replace(q, r'[-+*"():^]', " ")) <= 1), "shallow").otherwise("normal")


def normalize_verdict(verdict: Column) -> Column:
    v = F.lower(F.trim(verdict))
    table = F.create_map(*[F.lit(x) for kv in {**{v: v for v in VERDICTS}, **VERDICT_ALIASES}.items() for x in kv])
    return F.coalesce(F.try_element_at(table, v), F.lit("unsure"))


def is_unresolved(verdict: Column) -> Column:
    return normalize_verdict(verdict).isin("reverts", "conflicts")


def kinds_agree(one: Column, other: Column) -> Column:
    """Equal kinds agree, and "other" agrees with any; a null kind with none."""
    return F.coalesce((one == other) | (one == "other") | (other == "other"), F.lit(False))


def newer(a: Column, a_at: Column, b: Column, b_at: Column) -> Column:
    """The later side of a pair; b on ties."""
    return F.when(a_at > b_at, a).otherwise(b)


def enforce_floor(verdict: Column, confidence: Column) -> Column:
    return F.when((verdict == "conflicts") & (confidence < CONFLICT_FLOOR), "unsure").otherwise(verdict)


def slugify(kind: Column) -> Column:
    """A kind's slug, null where none is left."""
    s = F.regexp_replace(F.lower(F.trim(kind)), r"[\s-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]", ""), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s.rlike(SLUG), s)


def client_slug(raw: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z0-9._-]+", "-")
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^[-._]+|[-._]+$", ""), F.lit(64)), "[-._]+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def modality(mime: Column) -> Column:
    m = F.trim(F.substring_index(F.lower(mime), ";", 1))
    return F.when(m == "application/pdf", "pdf").when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").otherwise("other")


def truncate_marked(text: Column, most: int = 30_000, head: int = 24_000, tail: int = 4_000) -> Column:
    """Head, a marker (its wording is a fixed value) with the number of characters left out, and tail of long texts."""
    gone = F.format_number(F.length(text) - head - tail, 0)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("\n\n[TRUNCATED: "), gone, F.lit(" chars elided from middle]\n\n"), F.right(text, F.lit(tail)))).otherwise(text)


def searchable(*parts: Column) -> Column:
    """The non-empty parts, a line each."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5).cast("long")


def evidence_in_text(evidence: Column, text: Column) -> Column:
    """The normalised evidence, ten characters at least, stands in the normalised text."""
    e = norm(evidence)
    return (F.length(e) >= 10) & F.contains(norm(text), e)


def point_digest(text: Column) -> Column:
    return F.sha2(norm(text), 256)


def escape_for_log(text: Column, most: int = 200) -> Column:
    s = F.regexp_replace(text, r"[^\p{Print}\p{L}\p{N}\p{P}\p{S} ]", " ")
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 1)), F.lit("…"))).otherwise(s)
