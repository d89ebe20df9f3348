"""Scalar text functions as Spark expressions: identifiers, query terms, names, tokens, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops.
QUERY_STOPWORDS = tuple(
    "a an and are the of to in is it for on how does do what where which when why this that with by at be or as from into i we you my our".split()
)
#: Directories whose files support the code without being part of it.
SUPPORT_DIRS = ("__tests__", "__mocks__", "test", "tests", "bench", "benches", "benchmarks")
#: Letters and digits in the wide sense.
ALNUM = "\\p{IsAlphabetic}\\p{N}"

#: Language of a file by the last part of its name.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "rs": "rust", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html",
    "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "txt": "text", "prisma": "prisma", "sql": "sql",
}
LANGUAGE_CLASS = {x: "code" for x in ("typescript", "tsx", "javascript", "rust")} | {x: "document" for x in ("markdown", "html", "css", "json", "yaml", "toml", "text")} | {x: "schema" for x in ("prisma", "sql")}


#: Labels of tools, and groups of languages; everything else is its own label, or code.
TOOL_LABELS = {"repo_map": "Map", "find_symbol": "Find", "trace_path": "Trace", "changed": "Changed"}
LANGUAGE_GROUPS = {"markdown": "docs", "html": "docs", "text": "docs", "json": "config", "yaml": "config", "toml": "config", "css": "styles", "prisma": "schema", "sql": "schema"}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def split_identifier(s: Column) -> Column:
    """Lower-cased parts at non-alphanumerics, lower to upper, digit to upper and the end of a run of capitals."""
    cut = "[^\\p{L}\\p{N}]+|(?<=[\\p{Ll}\\p{N}])(?=\\p{Lu})|(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})"
    return F.transform(F.filter(F.split(s, cut), lambda x: x != ""), lambda x: F.lower(x))


def approx_tokens(s: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(s) / 4).cast("long")


def query_terms(s: Column) -> Column:
    """Identifier parts of a query of two characters or more, without stopwords, each once in order."""
    words = F.filter(F.split(s, f"[^{ALNUM}_]+"), lambda x: x != "")
    parts = F.flatten(F.transform(words, split_identifier))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin(*QUERY_STOPWORDS)))


def norm_name(s: Column) -> Column:
    """White space collapsed, lower-cased, trailing punctuation dropped."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, "(?U)\\s+", " "))), "[.,;:!?]+$", ""))


def clean(s: Column, most: int) -> Column:
    """Control characters dropped, white space collapsed, at most ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(s, "\\p{Cc}", ""), "(?U)\\s+", " ")), F.lit(most))


def note_text(s: Column) -> Column:
    """Runs of control characters and white space become one space."""
    return F.trim(F.regexp_replace(s, "(?U)[\\p{Cc}\\s]+", " "))


def squeeze_ws(s: Column) -> Column:
    """Runs of blanks become one space, runs of empty lines one line break."""
    spaces = F.regexp_replace(s, "[ \\t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaces, " ?\\n ?", "\n"), "\\n{2,}", "\n\n"))


def section_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def normalise_system(s: Column) -> Column:
    """Letters and digits alone, lower-cased."""
    return F.lower(F.regexp_replace(s, f"[^{ALNUM}]", ""))


def token_windows(tokens: Column, most: int = 6) -> Column:
    """Concatenations of up to ``most`` consecutive tokens; explode it to match normalised names by equality."""
    n = F.size(tokens)
    return F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.greatest(n - i + 1, F.lit(1)))), lambda k: F.array_join(F.slice(tokens, i, k), ""))))
    )


def matches_token_window(tokens: Column, norm: Column, most: int = 6) -> Column:
    return (norm != "") & F.array_contains(token_windows(tokens, most), norm)


def phrase_position(hay: Column, needle: Column) -> Column:
    """0-based place of the first whole-word occurrence, null without one."""
    quoted = F.concat(F.lit(f"(?<![{ALNUM}_])\\Q"), needle, F.lit(f"\\E(?![{ALNUM}_])"))
    place = F.regexp_instr(hay, quoted)
    return F.when((needle != "") & (place > 0), place - 1)


def name_matches_query(name: Column, terms: Column) -> Column:
    """The whole name is a term, or every part of it is."""
    parts = split_identifier(name)
    return F.array_contains(terms, F.lower(name)) | ((F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(terms, p)))


def note_matches(note: Column, terms: Column) -> Column:
    return F.arrays_overlap(query_terms(note), terms)


def is_support_file(path: Column, document: Column) -> Column:
    """Tests, specs, fixtures and examples; a document never is."""
    parts = F.split(path, "/")
    base, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~document & (base.contains(".test.") | base.contains(".spec.") | F.arrays_overlap(dirs, F.array(*map(F.lit, SUPPORT_DIRS))))


def is_excluded(path: Column, excludes: Column) -> Column:
    """An exact entry, or below one that ends in a slash."""
    return F.exists(excludes, lambda e: F.when(e.endswith("/"), path.startswith(e)).otherwise(path == e))


def language(path: Column) -> Column:
    """Language by what follows the last dot of the path, exactly as written; null if unknown."""
    return F.element_at(literal_map(LANGUAGES), F.element_at(F.split(path, "\\."), -1))


def language_class(lang: Column) -> Column:
    return F.element_at(literal_map(LANGUAGE_CLASS), lang)


def session_label(key: Column) -> Column:
    """Name of a session for people: the client of a tool session in title case, CLI, or UI."""
    slug = F.filter(F.split(F.split_part(key, F.lit(":"), F.lit(2)), "-"), lambda w: w != "")
    title = F.array_join(F.transform(slug, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")
    return F.when(key.startswith("mcp:"), title).when(key.startswith("cli-"), "CLI").when(key == "serve", "UI").otherwise(key)


def like_escape(s: Column) -> Column:
    return F.regexp_replace(s, "([\\\\%_])", "\\\\$1")


def extend_description(parts: Column, most: int = 300) -> Column:
    """Parts joined in order by "; ", one already held left out, cut to ``most`` characters."""
    joined = F.aggregate(parts, F.lit(""), lambda a, x: F.when(x.isNull() | (x == "") | F.array_contains(F.split(a, "; "), x), a).when(a == "", x).otherwise(F.concat(a, F.lit("; "), x)))
    return F.left(joined, F.lit(most))


def lower_camel(s: Column) -> Column:
    return F.concat(F.lower(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def unquote(s: Column) -> Column:
    """Last dotted part of an SQL name without its quotes or brackets."""
    return F.regexp_replace(F.element_at(F.split(s, "\\."), -1), "^[\"`\\[]+|[\"`\\]]+$", "")


def declared_names(answers: Column, most: int = 10) -> Column:
    """Answers ``path::name`` brought to one form, each once, the first ``most``: a plain name loses its qualifiers."""

    def one(a: Column) -> Column:
        a = F.regexp_replace(F.trim(a), "^\\./", "")
        path, name = F.split_part(a, F.lit("::"), F.lit(1)), F.trim(F.element_at(F.split(a, "::", 2), -1))
        plain = F.regexp_replace(F.regexp_replace(name, "^.*[./]", ""), "^#+", "")
        return F.when(a.contains("::") & (name != ""), F.concat(path, F.lit("::"), F.when(name.rlike("\\s"), name).otherwise(plain)))

    return F.slice(F.array_distinct(F.filter(F.transform(answers, one), lambda x: x.isNotNull())), 1, most)


def is_per_request_failure(error: Column) -> Column:
    """Failures of one request that say nothing about the service."""
    return error.contains("not JSON") | error.startswith("timed out") | error.contains(": HTTP 5")


def token_cost(fresh: Column, output: Column, cache_write: Column, cache_read: Column) -> Column:
    """Tokens weighed by price."""
    return fresh + 1.25 * cache_write + 0.1 * cache_read + 5 * output


def freshness(index_version: Column, head: Column, stale: Column, pending: Column | int = 0, models_out: bool = False, rebuilding: bool = False) -> Column:
    """One line on the index's state; the last three parts only where they apply."""
    pending = pending if isinstance(pending, Column) else F.lit(pending)
    short = F.when(head.contains(":"), head).when(F.coalesce(head, F.lit("")) != "", F.left(head, F.lit(7))).otherwise("none")
    state = F.when(stale > 0, F.format_string("STALE: %d files changed since index", stale.cast("long"))).otherwise("fresh")
    more = [F.when(pending > 0, F.format_string("entities: %d pending", pending.cast("long"))), F.lit("models: unavailable" if models_out else None), F.lit("embeddings: rebuilding" if rebuilding else None)]
    return F.concat_ws(" · ", F.concat(F.lit("index "), F.left(index_version, F.lit(6))), F.concat(F.lit("HEAD "), short), state, *[x.cast("string") for x in more])


def footer(served: Column, total: Column, recorded: Column) -> Column:
    """What a ranked answer shows of how much, and what was left out."""
    all_ = F.format_string("%d of %d symbols shown", served, total)
    return F.when(served >= total, all_).otherwise(F.concat(all_, F.format_string(" · %d more ranked below budget · %d recorded · widen with a larger budget or a focus file", total - served, recorded)))


def _listed(parts: Column) -> Column:
    """Joined by commas, the last by "and"."""
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(parts, -1)))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def reason_sentences(r: Column, rank: Column) -> Column:
    """What a reasons struct says, as an array of sentences; a field that is absent says nothing."""
    refs = F.transform(F.slice(r["referenced_by"], 1, 5), lambda x: F.concat(F.element_at(F.split(x["path"], "/"), -1), F.lit(" ("), x["count"].cast("string"), F.lit(")")))
    query = F.get(F.filter(r["seeds"], lambda s: s.startswith("query:")), 0)
    said = [
        F.concat(F.lit("Ranked "), ordinal(rank), F.lit(", score "), F.format_string("%.2f", r["score"]), F.lit(".")),
        F.when(F.size(r["referenced_by"]) > 0, F.concat(F.lit("Referenced from "), _listed(refs), F.lit("."))),
        F.when(r["query_ident_match"] & query.isNotNull(), F.concat(F.lit("Matched the query on "), F.substring(query, 7, 1 << 30), F.lit("."))).when(r["query_ident_match"] | r["fts_hit"], "Matched the query in the index."),
        F.when(r["note_hit"], "Matches a note."),
        F.when(r["body_hit"], "Matches the text of the section."),
        F.when(r["semantic"].isNotNull(), F.format_string("Semantically close to the query (%.2f).", r["semantic"])),
    ]
    entities = F.transform(F.coalesce(r["entities"], F.array().cast("array<string>")), lambda e: F.concat(F.lit("Mentions "), e, F.lit(".")))
    themes = F.transform(F.coalesce(r["themes"], F.array().cast("array<string>")), lambda e: F.concat(F.lit("Matches the theme "), e, F.lit(".")))
    implements = F.when(F.size(F.coalesce(r["implements"], F.array().cast("array<string>"))) > 0, F.concat(F.lit("Implements "), F.array_join(r["implements"], ", "), F.lit(".")))
    last = [F.when(F.array_contains(r["seeds"], "focus"), "You focused this file."), F.when(r["pinned"] | F.array_contains(r["seeds"], "pinned"), "Pinned.")]
    return F.array_compact(F.concat(F.array(*said), entities, F.array(implements), themes, F.array(*last)))


def node_size(n: Column, factor: float = 1.5) -> Column:
    return F.least(F.lit(4.0) + F.sqrt(n) * factor, F.lit(14.0))


def entropy(s: Column) -> Column:
    """Shannon bits per character."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")

    def term(c: Column) -> Column:
        share = F.size(F.filter(chars, lambda x: x == c)) / n
        return -share * F.log2(share)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + term(c))


def wiki_mentions(s: Column) -> Column:
    """Names in double brackets, without their alias."""
    return F.transform(F.regexp_extract_all(s, F.lit("\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]"), 1), lambda x: F.trim(x))


def code_mentions(s: Column) -> Column:
    """Code spans that hold one identifier, call brackets dropped."""
    return F.regexp_extract_all(s, F.lit("`([A-Za-z_$][\\w$]*)(?:\\(\\))?`"), 1)


def link_stem(href: Column) -> Column:
    """File stem of a relative link; null for absolute, mail and fragment links."""
    path = F.regexp_replace(href, "[?#].*$", "")
    base = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^.*/", "")
    stem = F.regexp_replace(base, "\\.[^.]*$", "")
    absolute = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("//") | href.startswith("#")
    return F.when(~absolute & (stem != ""), stem)


def json_answer(s: Column) -> Column:
    """Text between the first opening and the last closing brace."""
    return F.nullif(F.regexp_extract(s, "(?s)(\\{.*\\})", 1), F.lit(""))


def split_parts(s: Column, most: int = 6000) -> Column:
    """Paragraphs packed into parts of at most ``most`` bytes; a longer paragraph is cut by characters."""
    def pieces(p: Column) -> Column:
        n = F.ceil(F.length(p) / most).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(p, i * most + 1, F.lit(most)))
        return F.when(F.octet_length(p) <= most, F.array(p)).otherwise(cut)

    paragraphs = F.filter(F.flatten(F.transform(F.split(s, "\n\n"), pieces)), lambda p: F.trim(p) != "")

    def pack(a: Column, p: Column) -> Column:
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & (F.octet_length(F.coalesce(last, F.lit(""))) + 2 + F.octet_length(p) <= most)
        return F.when(F.size(a) == 0, F.array(p)).when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), p)))).otherwise(F.concat(a, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), pack)


def client_slug(name: Column) -> Column:
    """A client's name as a part of a session key: lower case, runs of white space and colons as one dash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "(?U)[\\s:]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "unknown").otherwise(slug)


def tool_label(tool: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(TOOL_LABELS), tool), tool)


def language_group(lang: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(LANGUAGE_GROUPS), lang), F.lit("code"))


def rfc3339(ms: Column) -> Column:
    """Milliseconds since 1970 as UTC to the second."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
