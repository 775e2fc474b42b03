"""Text cleaning: one rule table per function, applied to Columns or to Python strings.

A rule is (pattern, replacement with $n).  On Columns it is a ``regexp_replace`` in
the JVM; the chunkers, which already run in Python, use the same tables on strings.
Patterns use the syntax that Java and Python share.  Texts are expected with LF line
ends (``normalize_line_endings``).  Null stays null in all Column functions.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = tuple[tuple[str, str], ...]

# The patterns of each cleaning step, in the order they apply.
TRIM: Rules = ((r"\A[\s\uFEFF]+|[\s\uFEFF]+\Z", ""),)
LINE_ENDINGS: Rules = ((r"\r\n?", "\n"),)
WHITESPACE: Rules = ((r"\n{4,}", "\n\n\n"), (r"\n{3,}", "\n\n"), (r"(?m)[ \t]+$", ""), *TRIM)
HEADING: Rules = ((r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\s+", " "), *TRIM)
DESCRIPTION: Rules = ((r"\s+", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), *TRIM)
FENCES: Rules = ((r"(?s)```.*?```", ""),)
FRONTMATTER: Rules = ((r"(?s)\A(.*?)(?m:^)---.*?---\n*", "$1"),)
EXPORTS: Rules = ((r"(?m)^export\s+.*?;?\s*$", ""),)
IMPORTS: Rules = ((r"(?m)^import\s+.*?['\"];?\s*$", ""),)
HTML_EMBEDS: Rules = ((r"(?is)<div\s+style=\{\{[^}]*\}\}[^>]*>.*?</div>", ""), (r"(?is)<iframe.*?/>", ""), (r"(?is)<iframe.*?</iframe>", ""))
CALLOUTS: Rules = tuple((rf"(?is)<{k}>(.*?)</{k}>", f"\n> **{k}:** $1\n") for k in ("Note", "Warning", "Tip", "Info"))
ACCORDIONS: Rules = ((r'(?i)<Accordion\s+title="([^"]+)"[^>]*>', "\n#### $1\n"), (r"(?i)</Accordion>", ""), (r"(?i)</?AccordionGroup[^>]*>", ""))
CARDS: Rules = ((r"(?is)<Card[^>]*>.*?</Card>", ""), (r"(?is)<CardGroup[^>]*>.*?</CardGroup>", ""))
STEPS: Rules = ((r"(?i)</?Steps>", ""), (r'(?i)<Step\s+title="([^"]+)"[^>]*>', "\n**$1**\n"), (r"(?i)</Step>", ""))
WRAPPERS: Rules = ((r"(?i)<(?:Frame|Expandable|ParamField|ResponseField|CodeGroup|Tabs)[^>]*>", ""), (r"(?i)</(?:Frame|Expandable|ParamField|ResponseField|CodeGroup|Tabs)>", ""))
JSX: Rules = ((r"<[A-Z][a-zA-Z]*[^>]*/>", ""), (r"<[A-Z][a-zA-Z]*[^>]*>", ""), (r"</[A-Z][a-zA-Z]*>", ""))
FUMADOCS_CALLOUTS: Rules = ((r'(?is)<Callout\s+title="([^"]+)"[^>]*>\s*(.*?)\s*</Callout>', "\n> **$1:** $2\n"), (r"(?is)<Callout[^>]*>\s*(.*?)\s*</Callout>", "\n> $1\n"))
FUMADOCS_CARDS: Rules = ((r"(?i)</?Cards[^>]*>", ""), (r'(?is)<Card\s+title="([^"]+)"[^>]*>\s*(.*?)\s*</Card>', "- **$1**: $2"), (r'(?i)<Card\s+title="([^"]+)"[^>]*/>', "- **$1**"))
PREVIEWS: Rules = ((r"(?is)<PreviewComponents[^>]*>.*?</PreviewComponents>", ""), (r"(?is)<include[^>]*>.*?</include>", "[Code example - see documentation]"), (r"<[A-Z][a-zA-Z]*Demo\s*/>", ""))
URL_MARKER = r"(?im)^[ \t]*(?:[-*][ \t]+)?(?:\*\*)?URL(?:\*\*)?[ \t]*:[ \t]*(https?://[^\s)]+)"
FINAL: Rules = (*LINE_ENDINGS, *JSX, *WHITESPACE)
LEAST_PARAGRAPH = 30


def _java(pattern: str) -> str:
    """UNIX line ends for ^, $ and . ; Unicode white space for \\s."""
    return "(?dU)" + pattern.replace(r"\uFEFF", r"\x{FEFF}").replace(r"\Z", r"\z")


def apply(rules: Rules, c: Column) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, F.lit(_java(r[0])), F.lit(r[1])), rules, c)


@lru_cache(maxsize=512)
def _python(pattern: str, replacement: str) -> tuple[re.Pattern, str]:
    flags = re.match(r"\(\?([ims]+)\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    return re.compile((flags[0] if flags else "") + body), re.sub(r"\$(\d)", r"\\g<\1>", replacement.replace("\\", r"\\"))


#: Where a rule can only match texts that hold something, what that is: most texts are not searched at all.
_ONLY_IF = {
    LINE_ENDINGS[0][0]: lambda s: "\r" in s,
    WHITESPACE[0][0]: lambda s: "\n\n\n\n" in s,
    WHITESPACE[1][0]: lambda s: "\n\n\n" in s,
    WHITESPACE[2][0]: lambda s: " \n" in s or "\t\n" in s or s.endswith((" ", "\t")),
    TRIM[0][0]: lambda s: s != trimmed(s),
    **{pattern: (lambda s: "<" in s) for pattern, _ in JSX},
    **{pattern: (lambda s: "`" in s) for pattern, _ in (FENCES[0], HEADING[0])},
    **{pattern: (lambda s: "*" in s) for pattern, _ in HEADING[1:3]},
    HEADING[3][0]: lambda s: "](" in s,
}


def apply_str(rules: Rules, s: str) -> str:
    for pattern, replacement in rules:
        may = _ONLY_IF.get(pattern)
        if may is None or may(s):
            p, r = _python(pattern, replacement)
            s = p.sub(r, s)
    return s


# Fixed value: the white space of Unicode and the byte order mark.
SPACES = "\ufeff \t\n\r\v\f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def trimmed(s: str) -> str:
    return s.strip("\ufeff \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def normalize_line_endings(c: Column) -> Column:
    return apply(LINE_ENDINGS, c)


def normalize_whitespace(c: Column) -> Column:
    return apply(WHITESPACE, c)


def clean_heading(c: Column) -> Column:
    return apply(HEADING, c)


def remove_frontmatter(c: Column) -> Column:
    """Drops the first ``---`` block; only the first, wherever it stands."""
    return apply(FRONTMATTER, c)


def remove_imports_exports(c: Column) -> Column:
    """Import lines go while no fence has begun; export lines go everywhere."""
    fence = F.locate("```", c)
    head = F.when(fence > 1, F.substring(c, F.lit(1), fence - 1)).otherwise(c)
    tail = F.when(fence > 1, F.substring(c, fence, F.length(c))).otherwise(F.lit(""))
    return apply(EXPORTS, F.concat(apply(IMPORTS, head), tail))


def remove_imports_exports_str(s: str) -> str:
    at = s.find("```")
    head, tail = (s[:at], s[at:]) if at > 0 else (s, "")
    return apply_str(EXPORTS, apply_str(IMPORTS, head) + tail)


def remove_html_embeds(c: Column) -> Column:
    return apply(HTML_EMBEDS, c)


def convert_callouts(c: Column) -> Column:
    return apply(CALLOUTS, c)


def convert_accordions(c: Column) -> Column:
    return apply(ACCORDIONS, c)


def remove_cards(c: Column) -> Column:
    return apply(CARDS, c)


def convert_steps(c: Column) -> Column:
    return apply(STEPS, c)


def remove_wrapper_components(c: Column) -> Column:
    return apply(WRAPPERS, c)


def remove_jsx_tags(c: Column) -> Column:
    return apply(JSX, c)


def convert_fumadocs_callouts(c: Column) -> Column:
    return apply(FUMADOCS_CALLOUTS, c)


def convert_fumadocs_cards(c: Column) -> Column:
    return apply(FUMADOCS_CARDS, c)


def remove_component_previews(c: Column) -> Column:
    return apply(PREVIEWS, c)


def clean_mintlify(c: Column) -> Column:
    c = remove_imports_exports(remove_frontmatter(normalize_line_endings(c)))
    return apply((*WRAPPERS, *ACCORDIONS, *CARDS, *CALLOUTS, *STEPS, *WHITESPACE), c)


def clean_fumadocs(c: Column) -> Column:
    c = remove_imports_exports(normalize_line_endings(c))
    return apply((*HTML_EMBEDS, *FUMADOCS_CALLOUTS, *FUMADOCS_CARDS, *PREVIEWS, *WHITESPACE), c)


def is_fumadocs(c: Column) -> Column:
    return c.contains("items={[") | c.contains("<Callout type=")


def clean_mdx(c: Column) -> Column:
    return F.when(is_fumadocs(c), clean_fumadocs(c)).otherwise(clean_mintlify(c))


def clean_mdx_str(s: str) -> str:
    fumadocs = "items={[" in s or "<Callout type=" in s
    s = apply_str(LINE_ENDINGS, s)
    if fumadocs:
        return apply_str((*HTML_EMBEDS, *FUMADOCS_CALLOUTS, *FUMADOCS_CARDS, *PREVIEWS, *WHITESPACE), remove_imports_exports_str(s))
    s = remove_imports_exports_str(apply_str(FRONTMATTER, s))
    return apply_str((*WRAPPERS, *ACCORDIONS, *CARDS, *CALLOUTS, *STEPS, *WHITESPACE), s)


def final_cleanup(c: Column) -> Column:
    return apply(FINAL, c)


def extract_description(c: Column, max_length: int = 200) -> Column:
    """The first prose paragraph, cleaned and cut; '' if there is none."""
    paragraphs = F.transform(F.split(apply(FENCES, c), r"\n\n+"), js_trim)

    def prose(p: Column) -> Column:
        bold = p.startswith("**")
        listed = reduce(lambda a, b: a | b, [p.startswith(x) for x in "#-|>["]) | (p.startswith("*") & ~bold)
        return ~listed & ~(bold & p.endswith("**")) & (F.length(p) >= LEAST_PARAGRAPH)

    # the first one, bound once
    first = F.transform(F.slice(F.filter(paragraphs, prose), 1, 1), lambda p: apply(DESCRIPTION, p))
    cut = F.transform(first, lambda d: F.when(F.length(d) > max_length, F.concat(F.substring(d, 1, max_length - 3), F.lit("..."))).otherwise(d))
    return F.when(c.isNotNull(), F.coalesce(F.get(cut, 0), F.lit("")))


def description_str(s: str, max_length: int = 200) -> str:
    for part in re.split(r"\n\n+", apply_str(FENCES, s)):
        p = trimmed(part)
        bold = p.startswith("**")
        if len(p) < LEAST_PARAGRAPH or p[0] in "#-|>[" or (p[0] == "*" and not bold) or (bold and p.endswith("**")):
            continue
        p = apply_str(DESCRIPTION, p)
        return p[: max_length - 3] + "..." if len(p) > max_length else p
    return ""


def canonical_url(c: Column) -> Column:
    """The URL of a line-start marker; null without one."""
    found = F.regexp_extract(c, _java(URL_MARKER), 1)
    return F.when(found != "", F.regexp_replace(found, r"[.,;]+$", ""))


def canonical_url_str(s: str) -> str | None:
    m = re.search(URL_MARKER, s)
    return re.sub(r"[.,;]+$", "", m[1]) if m else None


def truncate_content(c: Column, limit: int = 8000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def first_subheading(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?dUm)^###\s+(.+)$", 1)
    return F.when(found != "", js_trim(found))


def strip_doc_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.(?:md|mdx|txt)$", "")


def sanitize_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")


def section_heading(heading: Column, breadcrumbs: Column, context: Column) -> Column:
    """Last meaningful breadcrumb and cleaned heading; versions become vX; else '{context} Documentation'."""
    useful = F.filter(breadcrumbs, lambda b: b.isNotNull() & ~b.isin("", "Introduction", "Documentation") & (F.length(b) > 3))
    own = F.when(heading.rlike(r"^\d+\.\d+\.\d+"), F.concat(F.lit("v"), F.get(F.split(heading, r"(?U)\s"), 0))).otherwise(clean_heading(heading))
    own = F.when((heading != "") & (heading != "Introduction"), own)
    crumb = F.when(F.size(useful) > 0, F.try_element_at(useful, F.lit(-1)))
    return F.when(crumb.isNull() & own.isNull(), F.concat(context, F.lit(" Documentation"))).otherwise(F.concat_ws(": ", crumb, own))


def file_source_url(kind: Column, base_url: Column, repository: Column, follow_links: Column, file: Column) -> Column:
    base = F.nullif(F.regexp_replace(F.coalesce(base_url, F.lit("")), "/$", ""), F.lit(""))
    at = lambda x: F.coalesce(F.concat(base, F.lit("/"), x), F.lit(""))
    return (
        F.when(F.coalesce(repository, F.lit("")) != "", F.concat(F.lit("https://github.com/"), repository, F.lit("/blob/main/"), file))
        .when((kind == "url") & F.coalesce(follow_links, F.lit(False)), at(strip_doc_extension(file)))
        .when(kind == "url", F.coalesce(base, F.lit("")))
        .otherwise(at(file))
    )


def file_context(context: Column, path: Column) -> Column:
    """'{context}/{name of the directory}' for files in a directory, else the context."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.concat(context, F.lit("/"), F.get(parts, F.size(parts) - 2))).otherwise(context)


def embedding_text(title: Column, heading: Column, content: Column, language: Column, repository: Column, method: Column, path: Column, description: Column) -> Column:
    """The parts of a chunk that are embedded, those present, joined by blank lines."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("SDK: "), some(repository)),
        F.concat(F.lit("Language: "), some(language)),
        some(title),
        F.when(heading.eqNullSafe(title), F.lit(None)).otherwise(some(heading)),
        F.concat(some(method), F.lit(" "), some(path)),
        some(description),
        some(content),
    )


def split_fences(c: Column) -> Column:
    """Alternating text and fence parts; joined they give the input."""
    return F.regexp_extract_all(c, F.lit(r"(?s)(```.*?```|.+?(?=```.*?```)|.+)"), F.lit(1))
