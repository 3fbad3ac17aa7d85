"""Text of questions, dialogue turns and paths: intents, cleaning, headers, citations, sentences, tags, symbols, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

# Patterns that results depend on.
INTENTS = {
    "temporal": r"\b(before|prior|previous|previously|original|originally|initial|initially|first|history|historical|timeline|chronological|chronologically|order|sequence|evolution|supersede|superseded|used\s+to|formerly|migrated\s+from|changed\s+from|when\s+did|what\s+was|over\s+time|across\s+sessions|across\s+my|throughout\s+our|summary|summarize|progressed|evolved)\b",
    "sequence": r"\b(chronological|chronologically|in\s+what\s+order|what\s+order|order\s+of|sequence\s+of|from\s+first\s+to\s+last|from\s+earliest\s+to\s+latest|exact\s+order|correct\s+order|order\s+did)\b",
    "update": r"\b(current|currently|latest|most\s+recent|updated|changed\s+to|switched\s+to|ended\s+up|now)\b",
}
RECALL = r"\b(tell\s+me|let\s+me\s+know|remind\s+me|recall|remember\s+when|remember\s+what|confirm|verify|check\s+whether|what\s+did\s+(?:i|we)|when\s+did\s+(?:i|we)|where\s+did\s+(?:i|we)|which\s+[a-z0-9_\s]{1,25}\s+did\s+(?:i|we)|have\s+(?:i|we)\s+ever|did\s+(?:i|we)\s+ever|how\s+many|how\s+long|how\s+much|summary\s+of\s+our|summarize\s+our|across\s+(?:all\s+)?(?:our\s+|my\s+)?sessions|throughout\s+our)\b"
ADVICE = r"^(?:please\s+)?(?:(?:can|could|would|will)\s+you\s+(?:please\s+)?(?:help\s+me\s+)?(?:write|draft|create|generate|build|implement|design|refactor|suggest|recommend|outline|plan|propose|advise|brainstorm|come\s+up\s+with|put\s+together)\b|(?:help\s+me\s+)?(?:write|draft|create|generate|build|implement|design|refactor|suggest|recommend|outline|plan|propose|brainstorm)\b|(?:give|provide)\s+me\s+(?:a|an|some)\b|what\s+(?:should\s+i|would\s+you\s+recommend|are\s+some\s+good|ideas)|how\s+(?:should\s+i|can\s+i)\b)"
FILLERS = [
    r"^(?:hey|hello|hi|greetings|dear|please)[,.\s]+",
    r"^(?:could you please|can you please|would you kindly|would you please|i want you to|i need you to|tell me|show me)[,.\s]+",
    r"\b(?:as we discussed earlier|like i mentioned before|as you know)\b",
    r"\b(?:thanks in advance|thank you very much|thank you|thanks|let me know what you think)[.!?\s]*$",
]
DIRECTIVE = r"\b(always|never|make sure to|please remember to|from now on|every time|whenever you|be sure to|don't ever|do not ever|remember that i want you to|i prefer|my preference|i like to|i'd rather|i would rather|i always use|i usually prefer|i'm a fan of|i tend to prefer|keep .* lightweight|minimal dependencies|favor .* over)\b"
TRANSITION = r"\b(switched\s+(?:from|to|my|our|the)|changed\s+(?:from|to|my|our|the)|moved\s+(?:from|to|my|our)|migrated\s+(?:from|to)|updated\s+(?:from|to|my|our|the)|upgraded\s+(?:from|to|my|our)|downgraded\s+(?:from|to)|instead\s+of\s+using|decided\s+to\s+(?:go\s+with|switch|use|change)|ended\s+up\s+(?:going\s+with|choosing|using|picking|switching)|no\s+longer\s+(?:use|using|work|working|live|living|need|want)|actually\s+(?:(?:i|we)\s+)?(?:now|switched|changed|moved|updated|decided)|(?:increased|decreased|raised|lowered|bumped|reduced|cut|doubled)\s+[^.|]{1,45}\s+to\b|now\s+(?:i'm|i\s+am|we're|we\s+are)\s+(?:using|working|living|running|going\s+with))\b"
CITATIONS = [
    (r"\[[^\]]*\bTurn\s*#\s*\d+(?:\s*/\s*\d+)?[^\]]*\]", " "),
    (r"\[[^\]]*\bTurn\s*#\s*\d*(?:\s*/\s*\d*)?$", " "),
    (r"\|\s*Turn\s*#\s*\d+(?:\s*/\s*\d+)?\s*\]?", " "),
    (r"\(?\bTurn\s*#\s*\d+(?:\s*/\s*\d+)?\)?\s*\]?", " "),
    (r"\[\s*\]", " "),
    (r"\s*\|\s*\|\s*", " | "),
    (r"^\s*\|\s*|\s*\|\s*$", " "),
]
BOILERPLATE = [r"(?im)Copyright\s+(?:\(c\)|©)?\s*\d{4}.*$", r"(?im)All\s+rights\s+reserved\.?", r"(?s)<!--.*?-->"]
MONTH_DAY = r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}"
TAG_STOP_WORDS = """the and for that this with from have were been what when where which will would there their about into some could them other
than then also only just more should each make made like time user very after before must need using used does done true false null
undefined http https file""".split()
TAG_PATTERNS = [r"\b([a-z]+[A-Z][a-zA-Z0-9]*|[A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]*|[a-z0-9]+_[a-z0-9_]+|[a-z0-9]+-[a-z0-9-]+)\b", r"\b[A-Z]{2,6}\b", r"\b[a-z]{4,}\b"]
IDENTIFIER = r"(?<![A-Za-z0-9_-])@[A-Za-z0-9_-]+/[A-Za-z0-9_./-]+|(?<![A-Za-z0-9_-])--[A-Za-z0-9][A-Za-z0-9_-]*|(?<![A-Za-z0-9_])[A-Za-z0-9_]+(?:[:./-][A-Za-z0-9_]+)+"
QUERY_PREFIXES = {"bge-large": "Represent this sentence for searching relevant passages: ", "snowflake-arctic-embed2": "query: ", "nomic-embed-text": "search_query: "}


def letters(text: Column, n: int) -> Column:
    """The first ``n`` signs of a text whose runs of other signs than A-Z and a-z are a blank each; null has none.

    No more of a text is rewritten than those signs need: all of it up to the n-th letter, and what follows that.
    """
    start = F.regexp_extract(F.coalesce(text, F.lit("")), f"^(?:[^A-Za-z]*+[A-Za-z]){{0,{n}}}+[^A-Za-z]?", 0)
    return F.substring(F.regexp_replace(start, "[^A-Za-z]+", " "), 1, n)


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def flat(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def intents(query: Column) -> dict[str, Column]:
    """Whether a question asks about history, an order of events, a current value, or for advice."""
    q = F.coalesce(query, F.lit(""))
    out = {k: q.rlike(any_case(p)) for k, p in INTENTS.items()}
    return out | {"advisory": ~out["update"] & ~out["sequence"] & ~q.rlike(any_case(RECALL)) & F.regexp_replace(q, r"^\s+", "").rlike(any_case(ADVICE))}


def clean_query(query: Column) -> Column:
    """A question without greeting, politeness and filler; the question itself where nothing is left."""
    out = query
    for p in FILLERS:
        out = F.regexp_replace(out, any_case(p), "")
    out = flat(out)
    return F.when(out == "", query).otherwise(out)


def directive(text: Column) -> Column:
    return text.rlike(any_case(DIRECTIVE))


def transition(text: Column) -> Column:
    return text.rlike(any_case(TRANSITION))


def session(text: Column, tags: Column | None = None) -> Column:
    """Session number from a header, any bracket of the text, or a tag."""
    number = lambda c, p: F.regexp_extract(c, any_case(p), 1).try_cast("long")
    found = F.coalesce(number(text, r"^\[[^\]]*\bSession[\s_-]*(\d+)\b[^\]]*\]"), number(text, r"\[[^\]]*\bSession[\s_-]*(\d+)\b[^\]]*\]"))
    return found if tags is None else F.coalesce(found, number(tags, r"\bsession[\s_-]*(\d+)\b"))


def turn_span(text: Column) -> Column:
    """struct<first, last> of a header's ``Turn #a/b``; b counts only as a + 1."""
    p = any_case(r"\bTurn\s*#\s*(\d+)(?:\s*/\s*(\d+))?")
    a, b = (F.regexp_extract(text, p, k).try_cast("long") for k in (1, 2))
    return F.when(a.isNotNull(), F.struct(a.alias("first"), F.when(b == a + 1, b).otherwise(a).alias("last")))


def date_label(text: Column) -> Column:
    """The date of a header, if it is none of a session's own labels."""
    label = F.trim(F.regexp_extract(F.regexp_extract(text, r"^\[([^\]]+)\]", 1), any_case(r"\bDate:\s*([^|\]]+?)(?:\s*\||$)"), 1))
    return F.when((label != "") & ~label.rlike(any_case(r"^session\s+\d+$")), label)


def strip_citations(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, by in CITATIONS:
        out = F.regexp_replace(out, any_case(pattern), by)
    return flat(out)


def without_boilerplate(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for p in BOILERPLATE:
        out = F.regexp_replace(out, p, "")
    return out


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\s+\|\s+"), lambda s: F.trim(s)), lambda s: s != "")


def matching_sentence(text: Column, pattern: str, most: int = 120) -> Column:
    """The first sentence that matches, else the text, cut to ``most`` characters."""
    clean = strip_citations(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " "))
    hit = F.get(F.filter(sentences(clean), lambda s: s.rlike(any_case(pattern))), F.lit(0))
    cut = lambda s: F.when(F.length(s) <= most, s).otherwise(F.concat(F.trim(F.substring(s, 1, most - 3)), F.lit("...")))
    return F.when(hit.isNotNull(), cut(hit)).otherwise(cut(flat(without_boilerplate(clean))))


def clamp(text: Column, tokens: int) -> Column:
    """At most ``tokens`` tokens of four characters each."""
    return F.when(F.ceil(F.length(text) / 4) <= tokens, text).otherwise(F.regexp_replace(F.substring(text, 1, max(1, 4 * tokens - 2)), r"\s+$", ""))


def timeline_entry(text: Column, most: int = 190) -> Column:
    """Badge (session and date) and a short body of a dialogue turn."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[[^\]]+\]\s*", "")
    s = session(text)
    badge = F.concat_ws(" · ", F.when(s.isNotNull(), F.concat(F.lit("Session "), s.cast("string"))), date_label(text))
    return F.struct(F.when(badge != "", F.concat(F.lit(" ("), badge, F.lit(")"))).otherwise("").alias("badge"), F.substring(strip_citations(without_boilerplate(body)), 1, most).alias("body"))


def phrases(query: Column) -> Column:
    """Contiguous content words of a question, two and three at a time, as they are and stemmed."""
    ws = F.filter(F.split(F.lower(query), "[^a-z0-9_.-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*words.STOP_WORDS, *words.META_WORDS))
    runs = lambda a, k: F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: F.array_join(F.slice(a, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    stemmed = F.transform(ws, words.stem)
    return F.array_distinct(F.concat(runs(ws, 2), runs(ws, 3), runs(stemmed, 2), runs(stemmed, 3)))


def heuristic_tags(text: Column, most: int = 5) -> Column:
    """Identifiers first, then acronyms, then words of four letters and more."""
    t = F.coalesce(text, F.lit(""))
    code, acronyms, plain = (F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda w: F.lower(w)) for c, p in zip((t, t, F.lower(t)), TAG_PATTERNS))
    known = lambda a: F.filter(a, lambda w: ~w.isin(*TAG_STOP_WORDS))
    return F.slice(F.array_distinct(F.concat(F.filter(known(code), lambda w: F.length(w) >= 3), known(acronyms), known(plain))), 1, most)


def camel_words(text: Column) -> Column:
    """Lower-cased text whose camel-case words are parted."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def variant_stems(text: Column, noise: list[str]) -> Column:
    """Stems of four letters and more of the parted words, without noise words and their stems."""
    ws = F.filter(F.split(camel_words(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$") & ~w.isin(*noise))
    silent = sorted({words.stem_word(w) for w in noise})  # the same for every row
    return F.array_distinct(F.filter(F.transform(ws, words.stem), lambda w: (F.length(w) >= 4) & ~w.isin(*silent)))


def symbols(text: Column, noise: list[str]) -> Column:
    """Technical names: paths, flags, dotted and hyphenated names, camel- and snake-case words, words of five letters and more."""
    t = F.coalesce(text, F.lit(""))
    joined = F.transform(F.regexp_extract_all(t, F.lit(IDENTIFIER), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, r"^[./:]+|[./:]+$", "")))
    plain = F.filter(F.regexp_extract_all(t, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0)), lambda w: w.rlike("[a-z][A-Z]|[A-Z][a-z0-9]+[A-Z]|_") | (F.length(w) >= 5))
    return F.array_distinct(F.filter(F.concat(joined, F.transform(plain, lambda w: F.lower(w))), lambda w: (F.length(w) >= 4) & ~w.isin(*noise)))


def holds_symbol(text: Column, symbol: Column) -> Column:
    """Whether a text holds a symbol that no word sign touches, whatever the case."""
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), F.replace(symbol, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.rlike(text, quoted)


def fnv1a(text: Column) -> Column:
    """FNV-1a over the characters, 32 bits, in base 36."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda a, c: F.expr("1") * ((a.bitwiseXOR(c) * 0x01000193).bitwiseAND(0xFFFFFFFF)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def content_hash(text: Column) -> Column:
    """SHA-256 of a text with plain line ends and no white space around it."""
    return F.sha2(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), r"^\s+|\s+$", ""), 256)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """struct<first, last>: lines of the characters ``start`` to ``end`` (exclusive)."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    first = breaks(F.substr(text, F.lit(1), start)) + 1
    return F.struct(first.alias("first"), (first + breaks(F.substr(text, start + 1, end - start))).alias("last"))


def chunks(text: Column, *, size: int = 1800, overlap: int = 250, single: int = 2000, most: int = 8) -> Column:
    """Windows of a long text; the last of ``most`` windows is the tail where they don't reach the end."""
    t, step = F.coalesce(text, F.lit("")), size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(t) - size) / step).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1), lambda i: F.substr(t, F.when((i == most - 1) & (n > most), F.length(t) - size).otherwise(i * step) + 1, F.lit(size)))
    return F.when(F.length(t) <= single, F.array(t)).otherwise(F.filter(cut, lambda c: F.trim(c) != ""))


def query_prefix(text: Column, model: str, instruction: str = "") -> Column:
    """A question in the form its embedding model wants."""
    if model.startswith("qwen3-embedding"):
        return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), text)
    return F.concat(F.lit(next((p for k, p in QUERY_PREFIXES.items() if model.startswith(k)), "")), text)
