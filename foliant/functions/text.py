"""Scalar text functions as native column expressions (FN01-FN57)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the document model.
ARXIV_NEW = r"\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}"
ARXIV_OLD = r"[a-zA-Z]+(?:[-.][a-zA-Z]+)*/\d{2}(?:0[1-9]|1[0-2])\d{3}"
ARXIV_ID = rf"({ARXIV_NEW}|{ARXIV_OLD})([vV][1-9]\d*)?"
NUMERIC_CITATION = r"\[(?:\d+[a-z]?(?:\s*[-,;]\s*\d+[a-z]?)*|\d+\s*(?:–|—)\s*\d+)\]"
AUTHOR_YEAR_CITATION = (
    r"\((?:[A-Z][A-Za-z'’\-]+(?:\s+et\s+al\.)?(?:\s+and\s+[A-Z][A-Za-z'’\-]+)?\s*,?\s*(?:19|20)\d{2}[a-z]?(?:\s*;\s*)?)+\)"
)
OBJECT_LABEL = r"((?:[A-Z]\.)?\d+(?:[.\-][A-Za-z0-9]+)*)"
OBJECT_REFERENCE = rf"(?i)\b(?:Figure|Fig\.?|Table|Algorithm|Equation|Eq\.?)\s*\(?{OBJECT_LABEL}\)?"
CAPTION = rf"(?i)^\s*(Figure|Fig\.?|Table|Algorithm)\s*{OBJECT_LABEL}\s*([:.\-])?\s*"
CAPTION_ANYWHERE = rf"(?i)\b(Figure|Fig\.?|Table|Algorithm)\s*{OBJECT_LABEL}\s*([:.\-])?\s*"
NUMBERED_HEADING = r"^((?:[1-9]\d*)(?:\.[1-9]?\d*){0,5})[.)]?\s+(.+)$"
APPENDIX_HEADING = r"(?i)^Appendix\s+([A-Z](?:\.\d+)*)[.)]?\s+(.+)$"
BARE_APPENDIX_HEADING = r"^([A-Z](?:\.\d+)*)[.)]?\s+([A-Z][A-Za-z].+)$"
REFERENCE_LABEL = r"^\s*(?:\[(\d+)\]|(\d+)\.)\s*"
PLAIN_CITATION = r"\[(?:\d+(?:\s*[-,]\s*\d+)*)\]"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
PROTECTED_TERM = (
    r"\b(?:LLMmap|LLM|GPT-?\d(?:\.\d+)?|BERT|Transformer|ImageNet|CIFAR-?\d+|OpenAI|Anthropic|Llama|Mistral|Gemini|Claude"
    r"|RAG|API|URL|DOI|JSON|HTML)\b"
)
SPECIAL_HEADINGS = [
    "abstract", "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments", "references", "bibliography",
]
SUPERSCRIPTS = ("0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾")
MATH_FONTS = r"(?i)cmmi|cmsy|cmex|math|symbol"


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def squeeze(text: Column) -> Column:
    """FN28: every run of Unicode white space becomes one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(text, r"(?U)^\s+|\s(?<!\s\s)\s*+$", "")  # a run is tried once, from its start


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def arxiv_id(value: Column) -> Column:
    """FN01: canonical identifier, or null where the value is not one."""
    raw = strip(value)
    path = F.regexp_extract(raw, r"(?i)^https://arxiv\.org/(?:abs|html|pdf)/(.+?)(?:\.pdf)?/?(?:[?#].*)?$", 1)
    own = F.when(raw.contains("://"), path).otherwise(raw)
    pattern = f"^{ARXIV_ID}$"
    body, version = F.regexp_extract(own, pattern, 1), F.lower(F.regexp_extract(own, pattern, 2))
    body = F.when(body.contains("/"), F.lower(body)).otherwise(body)
    return F.when(own.rlike(pattern), F.concat(body, version))


def resolved_id(watermark: Column) -> Column:
    """FN02: the first identifier that stands alone in a text."""
    found = F.regexp_extract(watermark, rf"(?<![\w./-])(?:{ARXIV_ID})(?![\w/-])", 0)
    return F.when(found != "", arxiv_id(found))


def same_paper(requested: Column, resolved: Column) -> Column:
    """FN03: equal ids; versions must agree only where one was requested."""
    base = lambda c: F.lower(F.regexp_replace(c, r"(?i)v\d+$", ""))
    known = arxiv_id(requested).isNotNull() & arxiv_id(resolved).isNotNull()
    free = ~requested.rlike(r"(?i)v\d+$")
    return F.coalesce(known & (base(requested) == base(resolved)) & (free | (F.lower(requested) == F.lower(resolved))), F.lit(False))


def job_id(identifier: Column, prefix: str = "arxiv-", suffix: str = "") -> Column:
    """FN04."""
    return F.concat(F.lit(prefix), F.regexp_replace(identifier, "/", "-"), F.lit(suffix))


def is_job_id(value: Column) -> Column:
    """FN04: 1 to 80 safe characters, the first a letter or digit."""
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$")


def slug(text: Column, limit: int = 56, default: str = "paper") -> Column:
    """FN05 (accents of Latin letters are folded; other letters separate)."""
    plain = F.lower(F.translate(text, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ",
                                "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"))
    core = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.btrim(F.substring(core, 1, limit), F.lit("-"))
    return F.when(cut == "", default).otherwise(cut)


def asset_name(url: Column, suffix: str = "") -> Column:
    """FN06: ten digits of the address's digest and a safe base name."""
    base = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "") if suffix else base
    safe = F.btrim(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), F.lit("-."))
    safe = F.rtrim(F.substring(F.when(safe == "", "asset").otherwise(safe), 1, 80), F.lit("-."))
    return F.concat(F.substring(F.sha2(url, 256), 1, 10), F.lit("-"), safe, F.lit(suffix))


def safe_stem(name: Column, index: Column) -> Column:
    """FN07."""
    core = F.btrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), F.lit("-."))
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("-"), F.substring(core, 1, 48))


def safe_ref(ref: Column) -> Column:
    """FN07: a graph reference as a lower-case identifier."""
    return F.btrim(F.regexp_replace(F.lower(ref), "[^a-z0-9]+", "-"), F.lit("-"))


def section_slug(number: Column, text: Column) -> Column:
    """FN08."""
    by_number = F.regexp_replace(F.lower(number), r"\.", "-")
    by_text = F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 48)
    base = F.when(F.coalesce(number, F.lit("")) != "", by_number).when(by_text == "", "section").otherwise(by_text)
    return F.concat(F.lit("sec-"), base)


def clean_text(text: Column) -> Column:
    """FN09: soft hyphens go, hyphenated line breaks close up, line breaks and blanks become spaces."""
    t = F.regexp_replace(text, "\u00ad", "")
    t = F.regexp_replace(t, r"(?<=[a-z])-\s*\n\s*(?=[a-z])", "")
    t = F.regexp_replace(t, r"\s*\n\s*", " ")
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


def canonical_furniture(text: Column) -> Column:
    """FN10."""
    return F.regexp_replace(F.lower(squeeze(text)), r"\d+", "#")


def canonical_reference(value: Column) -> Column:
    """FN11: singular kind and lower-case number."""
    v = squeeze(value)
    pattern = rf"(?i)^(Figures?|Figs?\.?|Tables?|Algorithms?|Equations?|Eqs?\.?)\s*\(?{OBJECT_LABEL}\)?$"
    raw = F.lower(F.regexp_extract(v, pattern, 1))
    kind = (
        F.when(raw.startswith("fig"), "figure").when(raw.startswith("table"), "table")
        .when(raw.startswith("algorithm"), "algorithm").otherwise("equation")
    )
    return F.when(v.rlike(pattern), F.concat(kind, F.lit(" "), F.lower(F.regexp_extract(v, pattern, 2)))).otherwise(F.lower(v))


def citations(text: Column) -> Column:
    """FN12: numeric groups, then author-year groups, first mentions in order."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.array_distinct(F.concat(every(NUMERIC_CITATION), every(AUTHOR_YEAR_CITATION)))


def object_references(text: Column) -> Column:
    """FN13."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(OBJECT_REFERENCE), F.lit(0)))


def expanded_references(text: Column) -> Column:
    """FN13, native form: lists such as ``Figures 1, 2 and 3`` give one canonical mention a number."""
    lists = F.regexp_extract_all(
        text, F.lit(rf"(?i)\b(?:Figures?|Figs?\.?|Tables?|Algorithms?|Equations?|Eqs?\.?)\s*\(?{OBJECT_LABEL}(?:\s*(?:,|and|&|,\s*and)\s*{OBJECT_LABEL})*\)?"),
        F.lit(0),
    )
    one = lambda m: F.transform(
        F.regexp_extract_all(m, F.lit(OBJECT_LABEL), F.lit(1)),
        lambda n: canonical_reference(F.concat(F.regexp_extract(m, r"(?i)^([A-Za-z]+)", 1), F.lit(" "), n)),
    )
    return F.array_distinct(F.flatten(F.transform(lists, one)))


def reference_label(text: Column) -> Column:
    """FN14: number of a leading ``[n]`` or ``n.``, else null."""
    found = F.concat(F.regexp_extract(text, REFERENCE_LABEL, 1), F.regexp_extract(text, REFERENCE_LABEL, 2))
    return F.nullif(found, F.lit(""))


def heading_details(text: Column) -> Column:
    """FN15: struct(number, level 1-6, title)."""
    t = squeeze(text)
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.)]?\s+\S", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    title = F.when(number != "", F.regexp_replace(t, r"^(?:\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)[.)]?\s+", "")).otherwise(t)
    return F.struct(
        F.nullif(number, F.lit("")).alias("number"), F.least(F.lit(6), dots + 1).cast("int").alias("level"), title.alias("title")
    )


def classify_legacy(text: Column, in_references: Column, size: Column, median_size: Column) -> Column:
    """FN16: reference, heading or paragraph."""
    t = strip(text)
    numbered = t.rlike(r"^(?:\d+(?:\.\d+)*|[A-Z])\.?\s+[A-Z].{0,120}$")
    return (
        F.when(in_references | t.rlike(r"^\[\d+\]\s"), "reference")
        .when((F.length(t) <= 140) & (numbered | F.lower(t).isin(SPECIAL_HEADINGS) | (size >= 1.16 * median_size)), "heading")
        .otherwise("paragraph")
    )


def heading(text: Column, font_max: Column, bold: Column, body_font: Column) -> Column:
    """FN17: struct(number, level, confidence), null where the block is no heading."""
    t = strip(text)
    bold = F.coalesce(bold, F.lit(False))
    font = F.coalesce(font_max, F.lit(0.0))
    plain = F.lower(F.regexp_replace(squeeze(t), ":+$", ""))
    made = lambda number, level, conf: F.struct(
        number.cast("string").alias("number"), level.cast("int").alias("level"), F.lit(conf).alias("confidence")
    )
    dots = lambda n: F.least(F.lit(6), F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) + 1)
    number = F.regexp_replace(F.regexp_extract(t, NUMBERED_HEADING, 1), r"\.+$", "")
    title = strip(F.regexp_extract(t, NUMBERED_HEADING, 2))
    is_numbered = t.rlike(NUMBERED_HEADING)
    junk = title.startswith(".") | title.rlike(r"^[\d.%+\-\s]+$")
    numbered_ok = (F.length(title) <= 150) & ((font >= body_font * 1.04) | (bold & number.contains(".")))
    letter = F.upper(F.coalesce(
        F.nullif(F.regexp_extract(t, APPENDIX_HEADING, 1), F.lit("")), F.regexp_extract(t, BARE_APPENDIX_HEADING, 1)
    ))
    none = F.lit(None)
    return (
        F.when(plain.isin(SPECIAL_HEADINGS), made(none, F.lit(1), 0.99))
        .when(is_numbered & junk, none)
        .when(is_numbered & numbered_ok, made(number, dots(number), 0.97))
        .when((letter != "") & (bold | (font >= body_font * 1.04)), made(letter, dots(letter), 0.9))
        .when(bold & (font >= body_font * 1.08) & (F.length(t) <= 90) & ~t.rlike(r"[.,;]$"), made(none, F.lit(1), 0.9))
    )


def caption_match(text: Column, font_max: Column, body_font: Column) -> Column:
    """FN18: struct(kind, label), null where the block is no caption."""
    panel = text.rlike(r"(?i)^\s*\([a-z]\)\s+")
    part = lambda k: F.when(text.rlike(CAPTION), F.regexp_extract(text, CAPTION, k)).when(
        panel, F.regexp_extract(text, CAPTION_ANYWHERE, k)
    ).otherwise("")
    kind = F.regexp_replace(F.lower(part(1)), r"\.+$", "")
    kind = F.when(kind == "fig", "figure").otherwise(kind)
    sure = (kind == "algorithm") | (part(3) != "") | (F.coalesce(font_max, body_font) <= body_font * 0.96)
    return F.when((part(1) != "") & sure, F.struct(kind.alias("kind"), part(2).alias("label")))


def looks_like_equation(
    text: Column, box: Column, font_max: Column, body_font: Column, fonts: Column, math_ratio: Column
) -> Column:
    """FN19."""
    t = strip(text)
    plain = (t == "") | (F.length(t) > 260) | t.rlike(CAPTION) | t.rlike(r"(?i)^(?:where|given|when|with|the)\b")
    centred = (box["x0"] > 0.08) & (box["x1"] < 0.92) & (box["x1"] - box["x0"] < 0.8)
    operator = t.rlike(r"[=≈≃≤≥∑∏∫√±×÷∂∇]|\b(?:argmax|argmin|log|exp)\b")
    numbered = t.rlike(r"\(\d+[a-z]?\)\s*$")
    symbols = F.regexp_count(t, F.lit(r"[=+*/<>_^{}()\[\]∑∏∫√±×÷∂∇]"))
    words = F.regexp_count(t, F.lit("[A-Za-z]{4,}"))
    font = F.exists(F.coalesce(fonts, F.array().cast("array<string>")), lambda f: f.rlike(MATH_FONTS))
    return ~plain & centred & (words <= 8) & (F.coalesce(font_max, body_font) <= body_font * 1.15) & (
        (operator & (numbered | (symbols >= 2))) | font | (F.coalesce(math_ratio, F.lit(0.0)) >= 0.28)
        | t.rlike(r"[\x00-\x1F]")
    )


def front_line_role(text: Column) -> Column:
    """FN20: metadata, affiliation or author."""
    t = squeeze(text)
    return (
        F.when(t.rlike(r"(?i)arxiv|preprint|copyright|©|doi|published|\b(?:19|20)\d{2}\b"), "metadata")
        .when(t.rlike(r"(?i)@|universit|institut|department|school|laborator|college|inc\.|\bltd"), "affiliation")
        .otherwise("author")
    )


def visual_kind(label: Column) -> Column:
    """FN21."""
    k = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z]+)", 1))
    return (
        F.when(k.startswith("fig") | k.isin("picture", "image", "chart", "plate"), "figure").when(k.startswith("tab"), "table")
        .when(k.startswith("alg") | k.isin("code", "listing"), "algorithm").when(k.startswith("eq") | (k == "formula"), "equation")
        .otherwise("figure")
    )


def displaced_diaeresis(text: Column) -> Column:
    """FN22: a detached diaeresis moves onto the vowel after it."""
    out = text
    for plain, marked in zip("aeiouAEIOU", "äëïöüÄËÏÖÜ", strict=True):
        out = F.regexp_replace(out, rf"¨\s*{plain}", marked)
    return out


def url_spacing(text: Column) -> Column:
    """FN23: spaces inside a printed address close up, however many: one pass that goes on where it stopped."""
    out = F.regexp_replace(text, r"(?i)\b(https?)\s*:\s*/\s*/\s*", "$1://")
    join = r"(?:(?<=[/._-])\s+(?=[a-z0-9])|\s+(?=[/._-][A-Za-z0-9]))"
    return F.regexp_replace(out, rf"((?:https?://|\G(?!\A))\S*?){join}", "$1")


def join_source_parts(parts: Column) -> Column:
    """FN26: an ordered array of printed parts as running text.

    A hyphen before a lower-case letter closes up; citations, superscripts, closing quotes and punctuation
    attach without a space.
    """
    plain = F.filter(F.transform(parts, squeeze), lambda v: v != "")
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    # a straight quote between letters or digits is an apostrophe
    quotes = lambda s, q: F.length(F.regexp_replace(F.regexp_replace(s, rf"(?<=[\p{{L}}\p{{N}}]){q}(?=[\p{{L}}\p{{N}}])", ""), f"[^{q}]", ""))
    odd = lambda s, q: quotes(s, q) % 2 == 1

    def opens(s: Column) -> Column:
        ends = lambda q: s.endswith(q) & odd(s, q) & ~s.rlike(rf"[\p{{L}}\p{{N}}]{q}$")
        return ends("'") | ends('"') | (s.endswith("‘") & (count(s, "‘") > count(s, "’"))) | (
            s.endswith("“") & (count(s, "“") > count(s, "”"))
        )

    def add(s: Column, v: Column) -> Column:
        close = (
            ((v == "'") & odd(s, "'")) | ((v == '"') & odd(s, '"'))
            | ((v == "’") & (count(s, "‘") > count(s, "’"))) | ((v == "”") & (count(s, "“") > count(s, "”")))
        )
        tight = (
            ((count(s, "[") > count(s, "]")) & v.rlike(r"^\d")) | v.rlike("^[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾]+$") | close
            | v.rlike(r"^[.,;:!?)\]}]") | s.rlike(r"[(\[{/—]$") | opens(s)
        )
        return (
            F.when(s == "", v)
            .when(s.endswith("-") & v.rlike(r"^\p{Ll}"), F.concat(F.expr("''"), F.regexp_replace(s, "-$", ""), v))
            .when(tight, F.concat(s, v)).otherwise(F.concat(s, F.lit(" "), v))
        )

    return F.aggregate(plain, F.lit(""), add)


def join_lines(lines: Column) -> Column:
    """FN27: lines joined by spaces, a hyphen before a lower-case letter closing up."""
    plain = F.filter(F.transform(lines, squeeze), lambda v: v != "")
    return F.aggregate(plain, F.lit(""), lambda s, v: F.when(s == "", v).when(
        s.rlike(r"\p{L}-$") & v.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(s, "-$", ""), v)
    ).otherwise(F.concat(s, F.lit(" "), v)))


def display_title(title: Column) -> Column:
    """FN29: overline commands lose their braces; spacing collapses."""
    return squeeze(F.regexp_replace(title, r"\\overline\s*\{([^{}]*)\}", "$1"))


def decode_entities(text: Column) -> Column:
    """FN29: the five predefined references, the ampersand last."""
    out = text
    for name, ch in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def published_at(value: Column) -> Column:
    """FN30: ``y-m-d`` at midnight UTC, else a lenient timestamp, else null."""
    day = F.regexp_extract(value, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 0)
    tidy = F.regexp_replace(day, "/", "-")
    return F.coalesce(F.try_to_timestamp(F.nullif(tidy, F.lit("")), F.lit("yyyy-M-d")), F.try_to_timestamp(value))


def normalize_tags(tags: Column, most: int = 12, longest: int = 32) -> Column:
    """FN31: squeezed, without blanks, first of each spelling; null where a tag is too long or there are too many."""
    plain = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), squeeze), lambda t: t != "")
    kept = F.aggregate(
        plain, F.array().cast("array<string>"),
        lambda have, t: F.when(F.exists(have, lambda h: F.lower(h) == F.lower(t)), have).otherwise(F.concat(have, F.array(t))),
    )
    return F.when((F.size(kept) <= most) & ~F.exists(kept, lambda t: F.length(t) > longest), kept)


def preferred_text(translated: Column, original: Column) -> Column:
    """FN32."""
    ja = strip(F.coalesce(translated, F.lit("")))
    return F.when(ja != "", ja).otherwise(strip(F.coalesce(original, F.lit(""))))


def escape_markdown(text: Column) -> Column:
    """FN33: inline marks everywhere, block marks at line starts, deep indents as character references."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")

    def line(raw: Column) -> Column:
        lead = F.regexp_extract(raw, r"^([ \t]*)", 1)
        tabs = F.replace(lead, F.lit("\t"), F.lit("    "))
        deep = F.length(tabs) >= 4
        rest = F.when(deep, F.substr(raw, F.length(lead) + 1)).otherwise(raw)
        body = F.regexp_replace(rest, r"([\\`*_\[\]<>|~$])", r"\\$1")
        body = F.regexp_replace(body, r"^(\s*)([#>+\-])(?=\s|$|#)", r"$1\\$2")
        body = F.regexp_replace(body, r"^(\s*\d+)([.)])(?=\s|$)", r"$1\\$2")
        body = F.regexp_replace(body, r"^(\s*)((?:=+|-{2,})\s*)$", r"$1\\$2")
        return F.concat(F.when(deep, F.repeat(F.lit("&#32;"), F.length(tabs))).otherwise(""), body)

    return F.array_join(F.transform(lines, line), "\n")


def is_safe_asset_path(path: Column) -> Column:
    """FN34, FN46: relative, without traversal, query or scheme, however often it is percent-encoded."""
    # every further encoding leaves one more "25" behind a percent sign, so that many rounds reach the end
    rounds = F.sequence(F.lit(0), F.length(path) - F.length(F.replace(path, F.lit("25"), F.lit("2"))))
    plain = F.aggregate(rounds, path, lambda p, _: F.coalesce(F.try_url_decode(p), p))
    return (
        (path != "") & ~plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:|^[/\\]|[?#\x00-\x1F\\]") & ~plain.rlike(r"(?:^|/)\.\.(?:/|$)")
    )


def is_local_asset(path: Column) -> Column:
    """FN46: below ``assets/``."""
    return is_safe_asset_path(path) & path.startswith("assets/")


def is_safe_link(url: Column) -> Column:
    """FN34: relative, or http(s) with a host, or mailto."""
    scheme = F.lower(F.regexp_extract(strip(url), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    return (strip(url) != "") & (
        (scheme == "") | (scheme == "mailto") | (scheme.isin("http", "https") & url.rlike(r"(?i)^\s*https?://[^/?#]+"))
    )


def is_safe_math(tex: Column) -> Column:
    """FN36: nothing in it that Markdown would read."""
    return ~tex.rlike(r"`|<[A-Za-z/!]|\]\(|\$|\n\s*\n")


def is_safe_display_math(tex: Column) -> Column:
    """FN36: as FN36 but balanced single dollars are allowed."""
    return ~tex.rlike(r"`|<[A-Za-z/!]|\]\(|\$\$|\n\s*\n") & (unescaped_dollars(tex) % 2 == 0)


def unescaped_dollars(tex: Column) -> Column:
    """RM12: dollars after an even number of backslashes."""
    return F.regexp_count(tex, F.lit(r"(?<!\\)(?:\\\\)*\$"))


def anchor_id(value: Column) -> Column:
    """FN37."""
    core = anchor_core(value)
    return F.when(core == "", "block").otherwise(core)


def anchor_core(value: Column) -> Column:
    """FN37 before its default; white space at the ends goes with the other signs there.

    ``\\w`` is A-Z, a-z, 0-9 and _ here, and takes an eighth of the time of these ranges.
    """
    return F.btrim(F.regexp_replace(value, r"[^\w.:-]+", "-"), F.lit("-"))


def markdown_safe_tex(tex: Column) -> Column:
    """FN38: spellings that Markdown would misread are replaced by equal ones."""
    out = tex
    for old, new in (("<", r"\lt "), (">", r"\gt "), ("|", r"\vert "), (r"\vert \vert ", r"\Vert ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def inline_code(value: Column) -> Column:
    """FN40: fenced by one backtick more than the longest run inside."""
    runs = F.transform(F.regexp_extract_all(value, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(value.rlike("^`|`$"), " ").otherwise("")
    return F.concat(fence, pad, value, pad, fence)


def code_fence(code: Column) -> Column:
    """TR14: a fence longer than any backtick run, three at least."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def replace_tokens(text: Column, tokens: Column) -> Column:
    """FN41, TR18: a map of replacements applied in order."""
    return F.aggregate(F.map_entries(tokens), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def invariant_warnings(original: Column, translated: Column) -> Column:
    """FN43: citations, DOIs and protected terms that were lost, and a length that is too short."""
    lost = lambda p: F.filter(
        F.regexp_extract_all(original, F.lit(p), F.lit(0)), lambda t: ~translated.contains(t)
    )
    cite, doi = lost(PLAIN_CITATION), lost(DOI)
    terms = F.array_sort(F.array_distinct(lost(PROTECTED_TERM)))
    say = lambda head, a, n: F.when(F.size(a) > 0, F.concat(F.lit(head), F.array_join(F.slice(a, 1, n), ", ")))
    short = (F.length(original) > 240) & (F.length(translated) < F.length(original) * 0.18)
    return F.array_compact(F.array(
        say("missing citation: ", cite, 5), say("missing DOI: ", doi, 5), say("missing protected terms: ", terms, 8),
        F.when(short, "translation may be incomplete"),
    ))


def raster_type(data: Column) -> Column:
    """FN44: image type by its first bytes."""
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    )


def raster_size(data: Column) -> Column:
    """FN44: struct(width, height) of PNG and GIF headers."""
    be = lambda at, n: F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("int")
    le = lambda at: F.conv(F.concat(F.hex(F.substring(data, at + 1, 1)), F.hex(F.substring(data, at, 1))), 16, 10).cast("int")
    kind = raster_type(data)
    return F.when(kind == "png", F.struct(be(17, 4).alias("width"), be(21, 4).alias("height"))).when(
        kind == "gif", F.struct(le(7).alias("width"), le(9).alias("height"))
    )


def has_unsafe_scheme(url: Column) -> Column:
    """FN45: a scheme other than http, https and mailto, once control characters are gone."""
    scheme = F.lower(F.regexp_extract(F.regexp_replace(url, r"[\x00-\x20\x7F]", ""), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    return (scheme != "") & ~scheme.isin("http", "https", "mailto")


def has_unsafe_css(style: Column) -> Column:
    """FN45."""
    return F.regexp_replace(F.lower(style), r"/\*.*?\*/|\s|\\", "").rlike(r"url\((?!['\"]?#)|@import|expression\(|javascript:|-moz-binding")


def version_key(value: Column) -> Column:
    """FN47: ordered struct; a pre-release sorts below its release; null where it is no version."""
    p = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    n = lambda k: F.regexp_extract(value, p, k).cast("int")
    pre = F.regexp_extract(value, p, 4)
    return F.when(value.rlike(p), F.struct(
        F.try_to_number(F.regexp_extract(value, p, 1), F.lit("999999999")).cast("int").alias("major"),
        F.try_to_number(F.regexp_extract(value, p, 2), F.lit("999999999")).cast("int").alias("minor"),
        F.try_to_number(F.regexp_extract(value, p, 3), F.lit("999999999")).cast("int").alias("patch"),
        (pre == "").alias("release"), pre.alias("pre"),
    ))


def event_time(value: Column) -> Column:
    """FN48: a timestamp with a zone, else null."""
    return F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(value)
    )


def sanitize_log(text: Column, roots: list[str], lines: int = 5, width: int = 240, total: int = 1000) -> Column:
    """FN49: paths hidden, control characters gone, lines and length bounded."""
    out = text
    for r in roots:
        out = F.replace(out, F.lit(r), F.lit("<path>"))
    parts = F.filter(F.split(F.regexp_replace(out, r"[\x00-\x09\x0B-\x1F\x7F]", " "), "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.array_join(F.transform(F.slice(parts, 1, lines), lambda x: F.substring(F.trim(x), 1, width)), " | "), 1, total)


def layout_placeholder(source: Column) -> Column:
    """FN50: filler of 45 % of the characters, two at least, starting at a digest's offset."""
    filler = "訳文配置確認用"
    n = F.greatest(F.lit(2), F.ceil(F.length(source) * 0.45)).cast("int")
    first = F.conv(F.substring(F.sha2(source, 256), 1, 2), 16, 10).cast("int") % len(filler)
    return F.substring(F.repeat(F.lit(filler), F.ceil((n + first) / len(filler)).cast("int")), first + 1, n)


def request_content(prompt: Column) -> Column:
    """FN51: what follows the last ``Input:`` marker."""
    return strip(F.substring_index(prompt, "Input:", -1))


def progress_units(share: Column) -> Column:
    """FN52: thousandths, within 0 and 100,000."""
    return F.least(F.lit(100000), F.greatest(F.lit(0), F.round(share * 1000).cast("long")))


def stage_of(name: Column) -> Column:
    """FN52."""
    n = F.lower(name)
    return (
        F.when(n.rlike("parse|layout|detect"), "parse").when(n.rlike("translat"), "translate")
        .when(n.rlike("typeset|render|font"), "typeset").when(n.rlike("save|write|merge"), "write").otherwise("other")
    )


def author_label(authors: Column, none: str = "Unknown author", more: str = " and others") -> Column:
    """FN53."""
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, none).when(
        F.size(authors) > 1, F.concat(F.get(authors, F.lit(0)), F.lit(more))
    ).otherwise(F.get(authors, F.lit(0)))


def source_label(resolved_id_: Column, source_type: Column) -> Column:
    """FN53."""
    return (
        F.when(F.coalesce(resolved_id_, F.lit("")) != "", F.concat(F.lit("arXiv:"), resolved_id_))
        .when(source_type == "pdf", "PDF").when(source_type == "unknown", "DOCUMENT").otherwise(F.upper(source_type))
    )


def progress_percent(completed: Column, total: Column, status: Column) -> Column:
    """FN53: whole percent, half rounding up."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.when(status == "completed", 100).otherwise(0)).otherwise(
        F.floor(completed / total * 100 + 0.5)
    ).cast("int")


def superscript(text: Column, raised: Column) -> Column:
    """FN54: raised digits and signs as Unicode superscripts."""
    return F.when(raised & text.rlike(r"^[0-9+\-=()]+$"), F.translate(text, *SUPERSCRIPTS)).otherwise(text)


def token_coverage(a: Column, b: Column) -> Column:
    """FN55: share of the tokens of ``a`` found in ``b``, with multiplicity."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    own, other = words(a), words(b)
    met = F.aggregate(
        F.transform(F.array_distinct(own), lambda w: F.least(times(own, w), times(other, w))), F.lit(0), lambda s, x: s + x
    )
    return F.when(F.size(own) == 0, 0.0).otherwise(met / F.size(own))


def ref_value(value: Column) -> Column:
    """FN57: a graph reference, written as a string or as an object with ``$ref``; null otherwise."""
    plain = strip(value)
    return F.when(plain.startswith("{"), F.get_json_object(plain, "$['$ref']")).when(plain.startswith("#/"), plain)


def content_layer(value: Column) -> Column:
    """FN57: body where nothing else is said."""
    return F.coalesce(F.nullif(F.lower(strip(value)), F.lit("")), F.lit("body"))


def page_number(value: Column) -> Column:
    """FN57: a whole number from 1 on, else null."""
    n = F.when(strip(value).rlike(r"^\d{1,9}$"), strip(value).cast("int"))
    return F.when(n >= 1, n)


def number_or(value: Column, default: float) -> Column:
    """FN57: a finite number, else the default."""
    n = F.when(strip(value).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?$"), strip(value).cast("double"))
    return F.coalesce(F.when(F.abs(n) < float("inf"), n), F.lit(float(default)))


def relative_asset(value: Column) -> Column:
    """FN57: a path with forward slashes and without a leading ``./``; null where it is not safe."""
    plain = F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    return F.when(is_safe_asset_path(plain), plain)


def markdown_destination(target: Column, prefix: str = "") -> Column:
    """RM09: a fragment as a (prefixed) anchor, a safe link in angle brackets where it has blanks; else null."""
    plain = strip(target)
    fragment = F.concat(F.lit(f"#{prefix}"), anchor_id(F.substring(plain, 2, 1_000_000)))
    shown = F.when(plain.rlike(r"[\s()<>]"), F.concat(F.lit("<"), F.regexp_replace(plain, r"[<>\s]", "%20"), F.lit(">"))).otherwise(plain)
    return F.when(plain.startswith("#"), F.when(F.length(plain) > 1, fragment)).when(is_safe_link(plain), shown)


def inline_anchor(value: Column, prefix: str = "") -> Column:
    """RM09."""
    return F.concat(F.lit(f'<a id="{prefix}'), anchor_id(value), F.lit('"></a>'))


def math_markdown(tex: Column, display: Column) -> Column:
    """RM09: inline or display mathematics, as code where Markdown would misread it."""
    t = strip(tex)
    block = F.concat(F.lit("$$\n"), t, F.lit("\n$$"))
    return F.when(display & is_safe_display_math(t), block).when(~display & is_safe_math(t), F.concat(F.lit("$"), t, F.lit("$"))).otherwise(inline_code(t))


def media_fallback(alt: Column, title: Column, caption: Column) -> Column:
    """RM10: what stands for a medium that cannot be shown: its own text, title or caption."""
    first = F.coalesce(*[F.nullif(squeeze(F.coalesce(c, F.lit(""))), F.lit("")) for c in (alt, title, caption)], F.lit("media"))
    return F.concat(F.lit("["), escape_markdown(first), F.lit("]"))


def attribute_text(value: Column) -> Column:
    """RM44: an attribute written as a JSON list or as a string, as one string."""
    items = F.from_json(value, "array<string>")
    return F.when(strip(value).startswith("[") & items.isNotNull(), F.array_join(items, " ")).otherwise(value)
