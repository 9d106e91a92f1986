"""Text, URL and path expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are no text.
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".zip", ".gz", ".tar", ".bz2", ".bin", ".exe", ".dll", ".so", ".dylib", ".pyc", ".pyo", ".class", ".lock")
#: Words that say nothing about relevance.
STOP_WORDS = ("given", "when", "then", "and", "but", "the", "for", "with", "that", "should", "user", "scenario", "feature", "source", "are", "not", "has", "have", "from", "this", "will", "can")
MAX_FILE_BYTES, MAX_REPO_FILES, MAX_UPLOAD_BYTES = 524_288, 100, 512 * 1024
SAMPLE_CHARS, PROMPT_CHARS, READ_CHARS = 2_000, 3_000, 8_000

KEY = r"[A-Z][A-Z0-9_]*-\d+"
#: White space of every script and line separators, as one regular-expression class and as characters.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space at either end, tabs, line ends and no-break spaces included; one pass, whatever the text."""
    return F.btrim(text, F.lit(SPACES))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def blob_url(url: Column, host: str = "github.com") -> Column:
    """owner, repo, ref (one segment) and path of a file's URL; null if it isn't one."""
    pattern = rf"^https?://{host.replace('.', chr(92) + '.')}/([^/]+)/([^/]+)/blob/([^/]+)/(.+)"
    u = strip(url)
    return F.when(u.rlike(pattern), F.struct(*(F.regexp_extract(u, pattern, k).alias(n) for k, n in enumerate(("owner", "repo", "ref", "path"), 1))))


def repo_url(url: Column, host: str = "github.com") -> Column:
    """owner and repo of a repository's URL, which may end in .git and a slash."""
    pattern = rf"^https?://{host.replace('.', chr(92) + '.')}/([^/]+)/([^/]+?)(?:\.git)?/?$"
    u = strip(url)
    return F.when(u.rlike(pattern), F.struct(F.regexp_extract(u, pattern, 1).alias("owner"), F.regexp_extract(u, pattern, 2).alias("repo")))


def pull_url(url: Column, host: str = "github.com") -> Column:
    """owner, repo and number of a pull request's URL; text may follow the number."""
    pattern = rf"^https?://{host.replace('.', chr(92) + '.')}/([^/]+)/([^/]+)/pull/(\d+)"
    u = strip(url)
    return F.when(u.rlike(pattern), F.struct(F.regexp_extract(u, pattern, 1).alias("owner"), F.regexp_extract(u, pattern, 2).alias("repo"), F.regexp_extract(u, pattern, 3).try_cast("bigint").alias("number")))


def repo_of_input(mode: Column, text: Column) -> Column:
    """owner/repo of what was entered, by mode; null where it doesn't parse or the mode is unknown."""
    slash = lambda s: F.concat(s["owner"], F.lit("/"), s["repo"])
    first_line = F.split(strip(text), r"\r?\n")[0]
    return F.when(mode == "full_repo", slash(repo_url(text))).when(mode == "pull_request", slash(pull_url(text))).when(mode == "exact_files", slash(blob_url(first_line)))


def ticket_key(text: Column) -> Column:
    """The ticket key of a bare key or a URL, by five patterns in order; '' if none. The last one leaves out the host."""
    upper = F.upper(strip(text))
    region = F.when(F.contains(upper, F.lit("//")), F.regexp_extract(upper, r"//[^/]*(/.*)$", 1)).otherwise(upper)
    patterns = ((upper, f"^({KEY})$"), (upper, f"/BROWSE/({KEY})"), (upper, f"/ISSUES?/({KEY})"), (upper, f"[?&](?:SELECTED)?ISSUES?=({KEY})"), (region, f"({KEY})"))
    return F.coalesce(*(_group(t, p) for t, p in patterns), F.lit(""))


def base_url(text: Column) -> Column:
    """Scheme and host, or ''."""
    return F.regexp_extract(strip(text), r"^(https?://[^/]+)", 1)


def suffix(path: Column) -> Column:
    """The last extension in lower case, with its dot; '' for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_text_path(path: Column) -> Column:
    return ~suffix(path).isin(*BINARY_EXTENSIONS)


def keywords(text: Column) -> Column:
    """Distinct lower-case words of three letters a to z or more, without stop words. Words are cut at whatever is no letter, digit or underscore of any script."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space, no-break spaces and the like included."""
    return F.split(text, "(?<=[.!?])" + SPACE + "+")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))


def object_path(*parts: Column) -> Column:
    """user/folder/path from the parts that aren't empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "/")


def csv_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*fields: Column) -> Column:
    """Every field in quotes."""
    return F.concat_ws(",", *map(csv_field, fields))


def decode_base64(content: Column) -> Column:
    """Text of base64 with line breaks; bytes that are no UTF-8 become replacement characters, null if it isn't base64."""
    return F.make_valid_utf8(F.try_to_binary(F.translate(content, "\n\r ", ""), F.lit("base64")).cast("string"))


def quote_query(text: Column) -> Column:
    """URL quoting that keeps + : and /; a space becomes %20."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2B"), F.lit("+")), F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))


def code_reference(file: Column, function: Column, line: Column) -> Column:
    """file, then the function and the line where they are set."""
    return F.concat(F.coalesce(file, F.lit("")), F.when(F.coalesce(function, F.lit("")) != "", F.concat(F.lit(" › "), function)).otherwise(""), F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""))


def absolute_link(link: Column, repo: Column, host: str = "https://github.com") -> Column:
    """Links stay; paths become the file's URL in the repository."""
    return F.when(link.startswith("http://") | link.startswith("https://"), link).otherwise(F.concat(F.lit(f"{host}/"), repo, F.lit("/blob/HEAD/"), link))


def directory_entry(name: Column, kind: Column) -> Column:
    return F.concat(name, F.when(kind == "dir", "/").otherwise(""))


def upload_problem(name: Column, content: Column) -> Column:
    """Why a feature file is refused, in order: its name, its size, its encoding; null if it is taken."""
    return F.when(~name.endswith(".feature"), "extension").when(F.octet_length(content) > MAX_UPLOAD_BYTES, "size").when(~F.is_valid_utf8(content.cast("string")), "encoding")


def pass_percent(passed: Column, total: Column) -> Column:
    """Rounded half up; 0 without scenarios, null without a summary."""
    return F.when(total.isNull(), None).when(total > 0, F.floor(100 * passed / total + 0.5)).otherwise(F.lit(0)).cast("bigint")


def accent(percent: Column) -> Column:
    return F.when(percent.isNull(), "").when(percent == 100, "emerald").when(percent == 0, "rose").otherwise("amber")


def phase(error: Column, ingesting: Column, generating: Column, bdd: Column, ticket: Column) -> Column:
    """What a session is at, by the first that holds."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(error), "error").when(ingesting, "ingesting").when(generating, "generating").when(has(bdd), "ready").when(has(ticket), "loaded").otherwise("idle")
