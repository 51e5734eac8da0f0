"""Scalar text functions as Column expressions, all inside code generation or Catalyst's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversational openings that carry no search term.
FILLER = (
    r"(?i)^\s*(?:please\s+)?(?:can\s+you\s+(?:tell\s+me|explain|describe)|could\s+you\s+(?:tell\s+me|explain|describe)|tell\s+me\s+about"
    r"|explain(?:\s+to\s+me)?|describe|what\s+(?:is|are|does|do|helps?|happens?|causes?)|how\s+(?:does|do|is|are|can|to)|why\s+(?:does|do|is|are)"
    r"|where\s+(?:does|do|is|are|can)|when\s+(?:does|do|is|are)|i\s+(?:want|need|would\s+like)\s+to\s+(?:know|understand|learn)|i\s+(?:wonder|am\s+wondering))\s+"
)
# Query classes.
COMPARATIVE = r"(?i)(\bvs\.?\b|\bversus\b|\bcompared?\s+(?:to|with|against)\b|\bbetter\s+than\b|\bworse\s+than\b|\bmore\s+effective\b|\bless\s+effective\b|\bdifference\s+between\b|\bsuperior\s+to\b|\bover\b.*\bor\b)"
EXPLORATORY_OPENERS = ["how does", "how do", "why does", "why do", "explain", "describe", "tell me about", "what role", "what factors"]
FACTUAL_OPENERS = ["what is", "what are", "what's the", "define", "definition of", "how much", "how many", "when was", "where is", "which", "is the"]
# Endings of drug names.
DRUG_ENDINGS = [
    "cillin", "mycin", "sporin", "statin", "prazole", "sartan", "olol", "pril", "tinib", "ciclib", "zumab", "ximab", "imab", "ridine", "oxetine", "tropine",
    "oxalone", "carbamol", "cyclobenzaprine", "barbital", "azepam", "azolam", "phylline", "triptan", "glitazone", "gliflozin", "semide", "floxacin",
]
# Words of a free-text question that do not describe an indication.
REVERSE_STOP = [
    "what", "which", "when", "where", "how", "does", "do", "is", "are", "the", "for", "with", "and", "or", "of", "to", "an", "from", "by", "in",
    "tell", "me", "show", "list", "find", "good", "best", "most", "drug", "drugs", "medication", "medications", "medicine", "medicines", "treatment",
    "treatments", "therapy", "therapies", "compound", "compounds", "agent", "agents", "approved", "fda", "rx", "help", "helps", "treat", "treats",
    "used", "use", "useful", "available", "common", "modern",
]
# Section headings and their types.
SECTIONS = {
    "introduction": "introduction", "background": "introduction", "intro": "introduction",
    "methods": "methods", "materials and methods": "methods", "material and methods": "methods", "patients and methods": "methods", "subjects and methods": "methods",
    "study design": "methods", "experimental procedures": "methods", "experimental design": "methods", "methodology": "methods", "methods and materials": "methods",
    "results": "results", "findings": "results", "outcomes": "results", "discussion": "discussion", "interpretation": "discussion",
    "conclusion": "conclusion", "conclusions": "conclusion", "concluding remarks": "conclusion", "summary": "conclusion", "abstract": "abstract",
}


def strip_filler(query: Column) -> Column:
    """The query without its opening phrase and outer `` ?.!,``; the whole query if nothing would be left."""
    bare = F.btrim(F.regexp_replace(query, FILLER, ""), F.lit(" ?.!,"))
    return F.when(F.trim(bare) == "", query).otherwise(bare)


def slug(text: Column) -> Column:
    """Lower case, runs outside a-z0-9 to '-', no outer '-'; 'node' if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("node"))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of four or more plain letters that stand alone."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([a-zA-Z]{4,})\b"), F.lit(1)), lambda w: F.lower(w)))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def markers(text: Column) -> Column:
    """Numbers of the ``[N]`` markers, in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("long"))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def provider_spec(spec: Column, default: str = "extractive") -> Column:
    """struct<provider, model> of ``provider[/model]``; blank or null is the default without a model."""
    clean = F.coalesce(F.nullif(F.trim(spec), F.lit("")), F.lit(default))
    cut = F.instr(clean, "/")
    name = F.lower(F.when(cut > 0, F.substring(clean, F.lit(1), cut - 1)).otherwise(clean))
    model = F.when(cut > 0, F.nullif(F.substring(clean, cut + 1, F.length(clean)), F.lit("")))
    return F.struct(name.alias("provider"), model.alias("model"))


def classify(query: Column) -> Column:
    """struct<query_type, top_k, provider>: comparative phrasing, then exploratory, then factual openings, else the default."""
    q = F.lower(F.trim(query))
    begins = lambda openers: F.exists(F.array(*(F.lit(o) for o in openers)), lambda o: F.startswith(q, o))
    kind = lambda t, k, p: F.struct(F.lit(t).alias("query_type"), F.lit(k).alias("top_k"), F.lit(p).alias("provider"))
    return F.when(q.rlike(COMPARATIVE), kind("comparative", 10, "llm")).when(begins(EXPLORATORY_OPENERS), kind("exploratory", 12, "llm")).when(begins(FACTUAL_OPENERS), kind("factual", 5, "extractive")).otherwise(kind("exploratory", 10, "llm"))


def content_terms(query: Column) -> Column:
    """Words of three or more letters or hyphens outside the stop list, order and repeats kept."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([a-zA-Z][a-zA-Z\-]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(REVERSE_STOP))


def phrase_patterns(terms: Column) -> Column:
    """LIKE patterns of neighbouring terms, and with the second cut to five letters if it is longer."""
    pairs = F.zip_with(F.slice(terms, 1, F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, 2, F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = F.transform(pairs, lambda p: F.concat(F.lit("%"), p["a"], F.lit("%"), p["b"], F.lit("%")))
    cut = F.transform(F.filter(pairs, lambda p: F.length(p["b"]) > 5), lambda p: F.concat(F.lit("%"), p["a"], F.lit("%"), F.left(p["b"], F.lit(5)), F.lit("%")))
    return F.when(F.size(terms) < 2, F.array().cast("array<string>")).otherwise(F.concat(whole, cut))


def drug_shaped(word: Column) -> Column:
    """An ending of the list; else eight letters or more with an x, y or z; else ten or more."""
    w = F.lower(word)
    return w.rlike(f"({'|'.join(DRUG_ENDINGS)})$") | ((F.length(w) >= 8) & w.rlike("[xyz]")) | (F.length(w) >= 10)


def dose_free(name: Column) -> Column:
    """The part before the first comma without numeric and MG tokens; null if under three characters are left."""
    kept = F.array_join(F.filter(F.split(F.trim(F.substring_index(name, ",", 1)), r"\s+"), lambda t: ~t.rlike(r"^[0-9.]+$") & ~F.upper(t).contains("MG")), " ")
    return F.when(F.length(kept) >= 3, kept)


def clean_history(role: Column, content: Column) -> Column:
    """Assistant turns without markers and the information-only notice, trimmed; other turns as they are."""
    bare = F.regexp_replace(content, r"\[\d+\]", "")
    bare = F.regexp_replace(bare, r"(?i)This is for information only — please.*?(?:\n|$)", "")
    return F.when(role == "assistant", F.regexp_replace(bare, r"^\s+|\s+$", "")).otherwise(content)


# Phrases that head the part of an answer that proposes further questions.
FOLLOW_UPS = (r"you\s+might\s+also\s+want\s+to\s+know", r"follow[-\s]?up\s+questions", r"suggested\s+questions", r"related\s+questions")


def answer_prose(text: Column) -> Column:
    """An answer as plain prose: without the part of further questions, the information-only notice and markers.

    The part begins at a line that starts with one of ``FOLLOW_UPS``, perhaps marked as bold or as a heading, and goes to the
    end.  Blanks and tabs collapse to one blank, three line ends or more to two.
    """
    bare = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(bare, rf"(?is)(?:\n|^)\s*(?:\*+|#+)?\s*(?:{'|'.join(FOLLOW_UPS)}).*", "")
    bare = F.regexp_replace(bare, r"(?i)this is for information only[^\n]*", "")
    for pattern, to in ((r"\[\d+\]", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        bare = F.regexp_replace(bare, pattern, to)
    return bare


def history_entry(text: Column, least: int = 6) -> Column:
    """What is kept of an answer for later turns; null if hardly anything is left."""
    bare = answer_prose(text)
    return F.when(F.length(bare) >= least, bare)


def prose(text: Column, most: int) -> Column:
    """White space collapsed; over ``most`` characters cut at the last ". " within 200 of the end, else at a blank, with "…"."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    cut = F.left(flat, F.lit(most))
    stop = F.length(cut) - F.instr(F.reverse(cut), " .") - 1
    has_stop = (F.instr(F.reverse(cut), " .") > 0) & (stop > most - 200)
    blank = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_blank = F.when(F.instr(F.reverse(cut), " ") > 0, F.substring(cut, F.lit(1), blank)).otherwise(cut)
    return F.when(F.length(flat) <= most, flat).when(has_stop, F.substring(cut, F.lit(1), stop + 1)).otherwise(F.concat(at_blank, F.lit("…")))


def section_type(title: Column) -> Column:
    """Type of a heading: lower case, without a final full stop, looked up; otherwise ``other``."""
    table = F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.rtrim(F.rtrim(F.lower(F.trim(title)), F.lit(".")))), F.lit("other"))


def author_name(last: Column, initials: Column) -> Column:
    """Last name and initials; null without a last name."""
    return F.concat(last, F.coalesce(F.concat(F.lit(" "), initials), F.lit("")))


def authors_short(names: Column) -> Column:
    """More than two names: the first and "et al."; one or two: a list; none: "Unknown"."""
    known = F.filter(names, lambda n: n.isNotNull())
    return F.when(F.size(known) > 2, F.concat(known[0], F.lit(", et al."))).when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("Unknown")


def valid_pmid(c: Column) -> Column:
    return c.rlike(r"^\d{1,20}$")


def valid_pmcid(c: Column) -> Column:
    return c.rlike(r"^PMC\d{1,16}$")


def clean_orcid(c: Column) -> Column:
    """The last ORCID-shaped part of the value; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\s*$", 1), F.lit(""))


def compact_date(c: Column) -> Column:
    """yyyymmdd to a date; null for anything else."""
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))


def search_terms(name: Column, synonyms: Column, most: int = 5, longest: int = 60) -> Column:
    """The name and synonyms up to ``longest`` characters, distinct without regard to case, the first ``most``."""
    every = F.filter(F.concat(F.array(name), F.coalesce(synonyms, F.array().cast("array<string>"))), lambda s: s.isNotNull() & (F.length(s) <= longest))
    keys = F.transform(every, lambda s: F.lower(s))
    return F.slice(F.filter(F.transform(every, lambda s, i: F.when(F.array_position(keys, F.lower(s)) == i + 1, s)), lambda s: s.isNotNull()), 1, most)
