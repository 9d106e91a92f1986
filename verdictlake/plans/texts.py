"""Scalar text, URL, path and ticket queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.functions import ticket as K
from verdictlake.operators import relevance as V
from verdictlake.plans.registry import query, table

_NON = r"[^\p{L}\p{N}_]+"
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_EXTS = ", ".join(f"'{e}'" for e in X.BINARY_EXTENSIONS)


@query("parse_page_url", r"select page_id, regexp_extract(trim(url), '^(https?://[^/]+)', 1) base from pages")
def parse_page_url(spark: SparkSession, d: str) -> DataFrame:
    """Scheme and host."""
    return table(spark, d, "pages").select("page_id", X.base_url(F.col("url")).alias("base"))


#: URLs of every kind out of parts, the same expression in both dialects.
_URL = "'https://github.com/' || p_brand || '/r' || cast(p_size as string) || case when p_partkey % 5 = 0 then '/blob/main/src/' || p_name || '.py' when p_partkey % 5 = 1 then '/pull/' || cast(p_partkey as string) || '/files' when p_partkey % 5 = 2 then '.git' when p_partkey % 5 = 3 then '/' else '' end"


@query("parse_blob_url", rf"select p_partkey, regexp_extract(u, p, 1) o, regexp_extract(u, p, 2) repo, regexp_extract(u, p, 3) ref, regexp_extract(u, p, 4) path from (select p_partkey, {_URL} u, '^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)' p from part) where regexp_matches(u, p)")
def parse_blob_url(spark: SparkSession, d: str) -> DataFrame:
    """Owner, repository, ref and path."""
    return table(spark, d, "part").select("p_partkey", X.blob_url(F.expr(_URL)).alias("b")).filter("b is not null").select("p_partkey", F.col("b.owner").alias("o"), "b.repo", "b.ref", "b.path")


@query("parse_repo_url", rf"select p_partkey, regexp_extract(u, p, 1) o, regexp_extract(u, p, 2) repo from (select p_partkey, {_URL} u, '^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$' p from part) where regexp_matches(u, p)")
def parse_repo_url(spark: SparkSession, d: str) -> DataFrame:
    """Owner and repository."""
    return table(spark, d, "part").select("p_partkey", X.repo_url(F.expr(_URL)).alias("r")).filter("r is not null").select("p_partkey", F.col("r.owner").alias("o"), "r.repo")


@query("parse_pull_url", rf"select p_partkey, regexp_extract(u, p, 1) o, regexp_extract(u, p, 2) repo, regexp_extract(u, p, 3)::bigint number from (select p_partkey, {_URL} u, '^https?://github\.com/([^/]+)/([^/]+)/pull/(\d+)' p from part) where regexp_matches(u, p)")
def parse_pull_url(spark: SparkSession, d: str) -> DataFrame:
    """C4: owner, repository and number."""
    return table(spark, d, "part").select("p_partkey", X.pull_url(F.expr(_URL)).alias("r")).filter("r is not null").select("p_partkey", F.col("r.owner").alias("o"), "r.repo", "r.number")


@query("repo_of_input", rf"""
with u as (select p_partkey, case p_partkey % 3 when 0 then 'exact_files' when 1 then 'full_repo' else 'pull_request' end mode, {_URL} u from part),
m as (select *, case mode when 'exact_files' then '^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)' when 'full_repo' then '^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$' else '^https?://github\.com/([^/]+)/([^/]+)/pull/(\d+)' end p from u)
select p_partkey, mode, case when regexp_matches(u, p) then regexp_extract(u, p, 1) || '/' || regexp_extract(u, p, 2) end repo from m""")
def repo_of_input(spark: SparkSession, d: str) -> DataFrame:
    """The repository of an input, by mode."""
    mode = F.expr("case p_partkey % 3 when 0 then 'exact_files' when 1 then 'full_repo' else 'pull_request' end")
    return table(spark, d, "part").select("p_partkey", mode.alias("mode"), X.repo_of_input(mode, F.expr(_URL)).alias("repo"))


_TICKET = "case o_orderkey % 6 when 0 then 'kan-' || cast(o_orderkey as string) when 1 then 'https://a-1.example.net/browse/AB_C-' || cast(o_custkey as string) when 2 then 'https://x.example.net/jira/issues/p1-' || cast(o_custkey as string) || '?f=1' when 3 then 'https://x.example.net/board?selectedIssue=QQ-' || cast(o_custkey as string) when 4 then 'https://kan-7.example.net/z/TT-' || cast(o_custkey as string) else 'https://kan-7.example.net/' end"
_KEY = r"[A-Z][A-Z0-9_]*-\d+"


@query("ticket_key", rf"""
with t as (select o_orderkey, upper(trim({_TICKET})) u from orders),
r as (select o_orderkey, u, case when contains(u, '//') then regexp_extract(u, '//[^/]*(/.*)$', 1) else u end region from t)
select o_orderkey, coalesce(nullif(regexp_extract(u, '^({_KEY})$', 1), ''), nullif(regexp_extract(u, '/BROWSE/({_KEY})', 1), ''), nullif(regexp_extract(u, '/ISSUES?/({_KEY})', 1), ''), nullif(regexp_extract(u, '[?&](?:SELECTED)?ISSUES?=({_KEY})', 1), ''), nullif(regexp_extract(region, '({_KEY})', 1), ''), '') ticket from r""")
def ticket_key(spark: SparkSession, d: str) -> DataFrame:
    """A ticket's key out of whatever was entered."""
    return table(spark, d, "orders").select("o_orderkey", X.ticket_key(F.expr(_TICKET)).alias("ticket"))


_PATH = "case p_partkey % 7 when 0 then 'a/.lock' when 1 then 'a.b/' || p_name || '.PNG' when 2 then 'src/' || p_name || '.py' when 3 then p_name when 4 then 'x/.env' when 5 then 'w/' || p_name || '.tar.gz' else 'y/' || p_name || '.ts' end"
_SIZE = "case when p_partkey % 11 = 0 then null when p_partkey % 11 = 1 then 524288 when p_partkey % 11 = 2 then 524289 else p_size end"


@query("file_filter", rf"select p_partkey, {_PATH} path from part where p_partkey % 13 <> 0 and not lower(regexp_extract({_PATH}, '[^/.][^/]*(\.[^./]+)$', 1)) in ({_EXTS}) and coalesce({_SIZE}, 0) <= 524288")
def file_filter(spark: SparkSession, d: str) -> DataFrame:
    """Text files of a tree within the size limit; a missing size counts as 0."""
    path = F.expr(_PATH)
    return table(spark, d, "part").filter((F.expr("p_partkey % 13 <> 0")) & X.is_text_path(path) & (F.coalesce(F.expr(_SIZE), F.lit(0)) <= X.MAX_FILE_BYTES)).select("p_partkey", path.alias("path"))


@query("repo_first_files", rf"select p_brand repo, p_partkey, path from (select p_brand, p_partkey, {_PATH} path, row_number() over (partition by p_brand order by p_partkey) n from part where not lower(regexp_extract({_PATH}, '[^/.][^/]*(\.[^./]+)$', 1)) in ({_EXTS})) where n <= 100 union all select distinct p_brand, -1, '[WARNING] tree truncated' from part where p_brand <= 'Brand#2'")
def repo_first_files(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred text files of each repository in tree order, and a warning row for cut trees."""
    from pyspark.sql import Window

    part = table(spark, d, "part").withColumn("path", F.expr(_PATH))
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    files = part.filter(X.is_text_path(F.col("path"))).withColumn("n", n).filter(F.col("n") <= X.MAX_REPO_FILES).select(F.col("p_brand").alias("repo"), "p_partkey", "path")
    warning = part.filter("p_brand <= 'Brand#2'").select(F.col("p_brand").alias("repo"), F.lit(-1).cast("bigint").alias("p_partkey"), F.lit("[WARNING] tree truncated").alias("path")).distinct()
    return files.unionByName(warning)


@query("pull_request_files", "select l_orderkey, l_linenumber, l_comment patch from (select l_orderkey, l_linenumber, l_returnflag status, case when l_linestatus = 'F' then 'patch ' || l_partkey end l_comment from lineitem) where status is distinct from 'R' and l_comment is not null")
def pull_request_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed files with a patch; files without a status stay."""
    patch = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("patch "), F.col("l_partkey").cast("string")))
    return table(spark, d, "lineitem").filter(~F.col("l_returnflag").eqNullSafe("R") & patch.isNotNull()).select("l_orderkey", "l_linenumber", patch.alias("patch"))


@query("warning_rows_dropped", "select doc_id, source || '/' || doc_id path from documents where not starts_with(case when doc_id % 9 = 0 then '[WARNING] ' else '' end || source, '[WARNING]')")
def warning_rows_dropped(spark: SparkSession, d: str) -> DataFrame:
    """rows that only warn are no files."""
    name = F.concat(F.when(F.col("doc_id") % 9 == 0, "[WARNING] ").otherwise(""), F.col("source"))
    return table(spark, d, "documents").filter(~name.startswith("[WARNING]")).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


@query("exact_file_lines", r"select doc_id, count(*) n_lines, min(trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160) || chr(133))) first_line from (select doc_id, unnest(string_split(text, chr(10))) line from documents) where trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160) || chr(133)) <> '' group by 1")
def exact_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines entered, without blank ones, handled inside each row."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 0).select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.array_min("l").alias("first_line"))


@query("scoped_path", "select doc_id, array_to_string(list_filter([cast(doc_id as string), nullif(lang, 'en'), source], lambda x: x is not null and x <> ''), '/') path, string_split(cast(doc_id as string) || '/' || source, '/')[1] = cast(doc_id as string) allowed from documents")
def scoped_path(spark: SparkSession, d: str) -> DataFrame:
    """Object paths, and whether their first part is the owner."""
    owner = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", X.object_path(owner, F.nullif("lang", F.lit("en")), F.col("source")).alias("path"), (F.split(F.concat(owner, F.lit("/"), "source"), "/")[0] == owner).alias("allowed"))


@query("code_reference_display", "select l_orderkey, l_linenumber, l_partkey, 'f' || l_partkey || case when l_returnflag <> 'N' then ' › ' || l_returnflag else '' end || case when l_linenumber <> 1 then ':' || l_linenumber else '' end shown from lineitem")
def code_reference_display(spark: SparkSession, d: str) -> DataFrame:
    """file, function and line as shown."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.code_reference(F.concat(F.lit("f"), F.col("l_partkey").cast("string")), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_linenumber") != 1, F.col("l_linenumber"))).alias("shown"))


@query("truncated_content", "select doc_id, md5(left(text, 8000)) head, length(left(text, 2000)) sample, length(left(text, 3000)) shown from documents")
def truncated_content(spark: SparkSession, d: str) -> DataFrame:
    """Contents cut at fixed numbers of characters."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.left("text", F.lit(X.READ_CHARS)).cast("binary")).alias("head"), F.length(F.left("text", F.lit(X.SAMPLE_CHARS))).cast("bigint").alias("sample"), F.length(F.left("text", F.lit(X.PROMPT_CHARS))).cast("bigint").alias("shown"))


@query("base64_content", "select doc_id, md5(decode(from_base64(to_base64(encode(text))))) digest from documents")
def base64_content(spark: SparkSession, d: str) -> DataFrame:
    """C20: base64 with line breaks back to text."""
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    return table(spark, d, "documents").select("doc_id", F.md5(X.decode_base64(coded).cast("binary")).alias("digest"))


@query("quoted_query", "select item_id, replace(replace(replace(url_encode(text), '%2B', '+'), '%3A', ':'), '%2F', '/') q from benchmark")
def quoted_query(spark: SparkSession, d: str) -> DataFrame:
    """Text for a search URL."""
    return table(spark, d, "benchmark").select("item_id", X.quote_query(F.col("text")).alias("q"))


@query("code_search", "select doc_id, path from (select doc_id, source || '/' || doc_id path, row_number() over (order by doc_id) n from documents where contains(lower(text), 'tion')) where n <= 10")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    """The first ten files that hold a text (a top-k, so that only ten rows a task are kept)."""
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")).orderBy("doc_id").limit(10)


@query("directory_listing", r"select distinct regexp_extract(url, '://([^/]+)', 1) host, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) || case when regexp_matches(url, '://[^/]+/[^/?#]+/') then '/' else '' end entry from pages")
def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    """Names under a place, folders with a slash."""
    name = F.regexp_extract("url", "://[^/]+/([^/?#]+)", 1)
    return table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), X.directory_entry(name, F.when(F.col("url").rlike("://[^/]+/[^/?#]+/"), "dir")).alias("entry")).distinct()


@query("upload_check", "select doc_id, case when not ends_with(name, '.feature') then 'extension' when strlen(text) * 8 > 524288 then 'size' end problem from (select doc_id, text, case when doc_id % 4 = 0 then 'x.txt' else 'x.feature' end name from documents)")
def upload_check(spark: SparkSession, d: str) -> DataFrame:
    """Why an upload is refused, if it is."""
    name = F.when(F.col("doc_id") % 4 == 0, "x.txt").otherwise("x.feature")
    return table(spark, d, "documents").select("doc_id", X.upload_problem(name, F.repeat("text", F.lit(8)).cast("binary")).alias("problem"))


@query("keyword_tokens", rf"select item_id, count(*) n, string_agg(w, ' ' order by w) words from (select distinct item_id, unnest(regexp_split_to_array(lower(text), '{_NON}')) w from benchmark) where regexp_full_match(w, '[a-z]{{3,}}') and w not in ({_STOPS}) group by 1")
def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    """What a scenario is about."""
    words = F.sort_array(X.keywords(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("words")).filter("n > 0")


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("scenario_id"), F.concat(F.lit("Scenario "), F.col("item_id").cast("string")).alias("title"), "text")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


_TOP6 = rf"""
with kw as (select distinct item_id, unnest(regexp_split_to_array(lower(text), '{_NON}')) w from benchmark),
k as (select * from kw where regexp_full_match(w, '[a-z]{{3,}}') and w not in ({_STOPS})),
f as (select doc_id pos, source || '/' || doc_id path, lower(source || '/' || doc_id) p, lower(left(text, 2000)) c from documents),
hit as (select w, pos, 3 * contains(p, w)::int + contains(c, w)::int s from (select distinct w from k), f),
sc as (select item_id, pos, sum(s)::bigint score from k join hit using (w) group by 1, 2),
r as (select item_id scenario_id, path, pos, score, row_number() over (partition by item_id order by score desc, pos) rank from sc join f using (pos))
"""


@query("relevance_top6", _TOP6 + "select * from r where rank <= 6")
def relevance_top6(spark: SparkSession, d: str) -> DataFrame:
    """The six files that fit each scenario best."""
    return V.top_files(_scenarios(spark, d), _files(spark, d))


@query("prompt_assembly", _TOP6 + ", a as (select scenario_id, string_agg('[F:' || r.path || ']' || chr(10) || left(text, 3000) || chr(10) || '[/F]', chr(10) order by rank) code from r join documents on pos = doc_id where rank <= 6 group by 1) select item_id scenario_id, md5('SCENARIO_ID:' || item_id || chr(10) || 'TITLE:Scenario ' || item_id || chr(10) || text || chr(10) || chr(10) || 'CODE:' || chr(10) || code) digest from benchmark join a on item_id = scenario_id")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each scenario."""
    s, f = _scenarios(spark, d), _files(spark, d)
    return V.prompts(s, f, V.top_files(s, f)).select("scenario_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


_LINK = "case p_partkey % 5 when 0 then 'https://h/' || p_name when 1 then p_type || '/' || p_name || '.py' when 2 then p_name || '.py' when 3 then 'app/' || p_type || '/' || p_name || '.py' else 'missing/' || cast(p_partkey as string) end"
_FILE = "p_type || '/' || p_name || '.py'"


@query("resolve_links", f"""
with f as (select {_FILE} path, min(p_partkey) pos, arg_max('https://h/blob/' || p_partkey, p_partkey) url from part where p_partkey % 3 <> 0 group by 1),
l as (select p_partkey link_id, {_LINK} link from part),
m as (select link, arg_min(url, row(path <> link, pos)) url from (select distinct link from l where link not like 'http%') join f on ends_with(path, link) or ends_with(link, path) group by 1)
select link_id, link, coalesce(m.url, link) url from l left join m using (link)""")
def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to files' URLs, exactly or by their endings."""
    part = table(spark, d, "part")
    files = part.select(F.expr(_FILE).alias("path"), F.col("p_partkey").alias("pos"), F.expr("case when p_partkey % 3 <> 0 then 'https://h/blob/' || cast(p_partkey as string) end").alias("github_url"))
    return V.resolve_links(part.select(F.col("p_partkey").alias("link_id"), F.expr(_LINK).alias("link")), files)


@query("absolute_links", "select p_partkey, case when starts_with(l, 'http://') or starts_with(l, 'https://') then l else 'https://github.com/' || p_brand || '/blob/HEAD/' || l end url from (select p_partkey, p_brand, " + _LINK + " l from part)")
def absolute_links(spark: SparkSession, d: str) -> DataFrame:
    """Paths to URLs without a lookup."""
    return table(spark, d, "part").select("p_partkey", X.absolute_link(F.expr(_LINK), F.col("p_brand")).alias("url"))


#: Ticket fields out of lineitems: a label and a text each.
_LABEL = "case l_linenumber % 5 when 0 then 'Acceptance Criteria' when 1 then 'AC' when 2 then 'Notes' when 3 then 'Acceptance' else 'customfield_' || cast(l_partkey as string) end"
_VALUE = "case l_suppkey % 6 when 0 then '' when 1 then 'Given x When y Then z ' || cast(l_partkey as string) when 2 then 'it must ' || cast(l_partkey as string) when 3 then 'see acceptance criteria ' || cast(l_partkey as string) when 4 then ' plain ' || cast(l_partkey as string) else 'Scenario ' || cast(l_partkey as string) end"
_POS = "l_linenumber * 1000000 + l_partkey"
_BEST = f"""
with v as (select l_orderkey, {_POS} pos, lower({_LABEL}) label, trim({_VALUE}) t, lower({_VALUE}) low from lineitem where trim({_VALUE}) <> ''),
s as (select *, case when contains(label, 'acceptance criteria') then 100 when label in ('ac', 'acceptance', 'acceptance criteria / notes') then 90 else 0 end + case when contains(low, 'acceptance criteria') then 40 else 0 end + case when contains(low, 'given') and contains(low, 'when') and contains(low, 'then') then 25 else 0 end + case when regexp_matches(low, 'must|should|shall|scenario') then 10 else 0 end score from v),
b as (select l_orderkey, arg_max(t, row(score, -pos)) ac, max(score)::bigint score from s where score > 0 group by 1)
"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ticket_id"), F.expr(_POS).alias("pos"), F.expr(_LABEL).alias("label"), F.expr(_VALUE).alias("value"))
    return K.best_field(fields)


@query("ac_field_pick", _BEST + "select l_orderkey ticket_id, ac, score from b")
def ac_field_pick(spark: SparkSession, d: str) -> DataFrame:
    """The field that looks most like acceptance criteria."""
    return _best(spark, d).select("ticket_id", "ac", F.col("score").cast("bigint").alias("score"))


_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_DESC = "case o_orderkey % 7 when 5 then 'x' || chr(13) || chr(10) || chr(9) || 'Acceptance Criterion :' || chr(9) || chr(13) || chr(10) || chr(9) || chr(13) || chr(10) || chr(9) || 'tab ' || cast(o_custkey as string) || chr(9) || chr(13) || chr(10) || chr(9) || chr(13) || chr(10) || 'two' when 6 then chr(9) || 'acceptance criteria:' || chr(160) || 'in line ' || cast(o_custkey as string) || chr(9) || chr(13) || chr(10) else case o_orderkey % 5 when 0 then 'Intro' || chr(10) || 'Acceptance Criteria:' || chr(10) || chr(10) || '- one ' || cast(o_custkey as string) || chr(10) || ' two ' || chr(10) || chr(10) || 'after' when 1 then 'Business rules' || chr(10) || 'r ' || cast(o_custkey as string) || chr(10) || 'Next part:' || chr(10) || 'x' when 2 then 'A' || chr(10) || ' ac: inline ' || cast(o_custkey as string) when 3 then '  only ' || cast(o_custkey as string) else '' end end"
_SECTION = "case o_orderkey % 7 when 5 then 'tab ' || cast(o_custkey as string) when 6 then 'in line ' || cast(o_custkey as string) else case o_orderkey % 5 when 0 then '- one ' || cast(o_custkey as string) || chr(10) || 'two' when 1 then 'r ' || cast(o_custkey as string) when 2 then 'inline ' || cast(o_custkey as string) else '' end end"


@query("ac_section", f"select o_orderkey, {_SECTION} body from orders")
def ac_section(spark: SparkSession, d: str) -> DataFrame:
    """The part of a description under a heading."""
    return table(spark, d, "orders").select("o_orderkey", K.section(F.expr(_DESC)).alias("body"))


@query("ac_cascade", _BEST + f"select o_orderkey, a ac, length(a) >= 20 usable from (select o_orderkey, coalesce(nullif(b.ac, ''), nullif({_SECTION}, ''), nullif(trim({_DESC}, {_WHITE}), ''), 'Summary ' || o_orderpriority) a from orders left join b on o_orderkey = l_orderkey)")
def ac_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The cascade from fields to summary, and F12: whether it is long enough."""
    ac = K.cascade(F.col("ac"), F.expr(_DESC), F.expr("'Summary ' || o_orderpriority"))
    return table(spark, d, "orders").join(_best(spark, d), F.col("o_orderkey") == F.col("ticket_id"), "left").select("o_orderkey", ac.alias("ac")).withColumn("usable", K.is_usable(F.col("ac")))


@query("field_label", "select event_id, lower(case json_extract_string(props, '$.k')::int % 3 when 0 then 'Acceptance Criteria' when 1 then 'Notes' else 'k' || json_extract_string(props, '$.k') end) label from events")
def field_label(spark: SparkSession, d: str) -> DataFrame:
    """A field's label by its key, else the key."""
    k = F.get_json_object("props", "$.k")
    names = F.create_map(F.lit("k0"), F.lit("Acceptance Criteria"), F.lit("k1"), F.lit("Notes"))
    key = F.when(k.cast("int") % 3 == 0, "k0").when(k.cast("int") % 3 == 1, "k1").otherwise(F.concat(F.lit("k"), k))
    return table(spark, d, "events").select("event_id", F.lower(F.coalesce(F.try_element_at(names, key), key)).alias("label"))


@query("linked_issue_keys", "select o_orderkey, array_to_string(list_filter([case when o_custkey % 2 = 0 then case when o_custkey % 4 = 0 then 'OUT-' || o_custkey end else 'IN-' || o_custkey end, 'IN-' || o_orderkey], lambda x: x is not null), ',') keys from orders")
def linked_issue_keys(spark: SparkSession, d: str) -> DataFrame:
    """keys of linked issues; an outward issue without a key hides the inward one."""
    issue = lambda k: F.struct(k.alias("key"))
    c = F.col("o_custkey")
    out = F.when(c % 2 == 0, issue(F.when(c % 4 == 0, F.concat(F.lit("OUT-"), c.cast("string")))))
    links = F.array(F.struct(out.alias("outwardIssue"), issue(F.concat(F.lit("IN-"), c.cast("string"))).alias("inwardIssue")), F.struct(F.lit(None).cast("struct<key:string>").alias("outwardIssue"), issue(F.concat(F.lit("IN-"), F.col("o_orderkey").cast("string"))).alias("inwardIssue")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(K.linked_keys(links), ",").alias("keys"))


@query("document_tree_text", "select p_partkey, p_name || ' ' || p_brand || ' ' || p_type t from part")
def document_tree_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of nested documents, in order."""
    leaf = lambda c: F.concat(F.lit('{"type":"text","text":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("}"))
    tree = F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":['), leaf(F.col("p_name")), F.lit(","), leaf(F.col("p_brand")), F.lit(']},{"type":"list","content":['), leaf(F.col("p_type")), F.lit("]}]}"))
    return table(spark, d, "part").select("p_partkey", K.field_text(tree).alias("t"))
