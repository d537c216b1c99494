"""Change sets and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.operators import changesets as X
from ledgerframe.operators import templates as M
from ledgerframe.sources import change_json as J
from ledgerframe.suite import sqltext as S
from ledgerframe.suite.registry import query

YEAR = 2024


@query(
    "filter_commits",
    """select change_id, pos, sha, case when contains(message, 'Merge branch ''master'' into') then 'skipped' else 'kept' end as action
    from commits where sha <> ''""",
)
def _(v):
    return X.filter_commits(v("commits"))


FLAGS = """starts_with(filename, 'db/') as in_db, starts_with(filename, 'db/scripts/') as in_scripts,
    starts_with(filename, 'db/ddl/packages/') as in_packages,
    starts_with(filename, 'db/ddl/') and not starts_with(filename, 'db/ddl/packages/') as non_package_ddl"""


@query("classify_files", f"select change_id, pos, filename, {FLAGS} from change_files")
def _(v):
    return X.classify_files(v("change_files"))


@query(
    "change_warnings",
    f"""select distinct change_id, '{X.NON_PACKAGE_WARNING}' as warning from (select change_id, {FLAGS} from change_files) where non_package_ddl""",
)
def _(v):
    return X.change_warnings(v("change_files"))


FILE = "regexp_extract(filename, '[^/]*$')"
PACKAGES = rf"""select distinct change_id, lower(regexp_replace({FILE}, '(_spec)?\.sql$', '')) as package_name
    from change_files where starts_with(filename, 'db/ddl/packages/') and ends_with(filename, '.sql')"""


@query("detect_packages", PACKAGES)
def _(v):
    return X.detect_packages(v("change_files"))


STEM = rf"string_split(regexp_replace({FILE}, '(_rollback)?\.sql$', ''), '_')"
GOOD = f"ends_with(filename, '.sql') and len({STEM}) >= 2"
PARSED = f"""select change_id, pos, filename, case when {GOOD} then ({STEM})[1] end as number, case when {GOOD} then ({STEM})[2] end as branch,
    case when {GOOD} then lower(array_to_string(({STEM})[3:], '_')) end as package_name,
    ends_with(filename, '_rollback.sql') as is_rollback, {GOOD} as is_valid from change_files where starts_with(filename, 'db/scripts/')"""


@query("parse_change_script", PARSED)
def _(v):
    return X.parse_change_script(v("change_files"))


def candidates(rollback: bool) -> str:
    return f"""select change_id, package_name, {FILE} as script_name, cast(cast(number as bigint) as varchar) as number, branch
    from ({PARSED}) where is_valid and is_rollback = {str(rollback).lower()} and package_name <> '' and regexp_matches(number, '^[0-9]+$')
      and (change_id, package_name) in ({PACKAGES})
    qualify row_number() over (partition by change_id, package_name order by pos desc) = 1"""


@query("change_candidates", candidates(False))
def _(v):
    return X.change_candidates(v("change_files"), rollback=False)


@query("change_candidates_rollback", candidates(True))
def _(v):
    return X.change_candidates(v("change_files"), rollback=True)


@query(
    "compose_package_script",
    f"select edition, package_name, {S.package_script('spec', 'body')} as text, spec is not null as is_valid from package_sources",
)
def _(v):
    return X.compose_package_script(v("package_sources"))


@query(
    "rewrite_year_range",
    f"select edition, package_name, {S.year_range('spec', YEAR)} as spec, {S.year_range('body', YEAR)} as body from package_sources",
)
def _(v):
    return X.rewrite_year_range(v("package_sources"), YEAR)


REGENERATED = f"""select change_id, package_name, true as is_rollback, number || '_' || branch || '_' || package_name || '_rollback.sql' as file_name,
      {S.package_script('spec', 'body')} as text from ({candidates(True)}) join package_sources using (package_name) where edition = 'before'
    union all
    select change_id, package_name, false as is_rollback, number || '_' || branch || '_' || package_name || '.sql' as file_name,
      {S.year_range(S.package_script('spec', 'body'), YEAR)} as text from ({candidates(False)}) join package_sources using (package_name) where edition = 'after'"""


@query("regenerate_scripts", REGENERATED)
def _(v):
    return X.regenerate_scripts(v("change_files"), v("package_sources"), YEAR)


def missing(rollback: bool, edition: str) -> str:
    return f"""select change_id, package_name, {str(rollback).lower()} as is_rollback from ({candidates(rollback)})
    where package_name not in (select package_name from package_sources where edition = '{edition}' and spec is not null)"""


MISSING = f"{missing(True, 'before')} union all {missing(False, 'after')}"


@query("missing_sources", MISSING)
def _(v):
    return X.missing_sources(v("change_files"), v("package_sources"))


@query(
    "change_summary_by_set",
    f"""with w as (select change_id, count(*) filter (not is_rollback) as f, count(*) filter (is_rollback) as b from ({REGENERATED}) group by change_id),
    m as (select change_id, count(*) as n from ({MISSING}) group by change_id)
    select change_id, coalesce(f, 0) as scripts_written, coalesce(b, 0) as rollback_scripts_written, coalesce(n, 0) as scripts_missing, case when warned then 1 else 0 end as n_warnings,
      has_scripts or coalesce(f, 0) + coalesce(b, 0) > 0 as should_run
    from (select change_id, bool_or(in_scripts) as has_scripts, bool_or(non_package_ddl) as warned from (select change_id, {FLAGS} from change_files) group by change_id)
    left join w using (change_id) left join m using (change_id)""",
)
def _(v):
    return X.change_summary_by_set(v("change_files"), v("package_sources"), YEAR)


# --- JSON -----------------------------------------------------------------------


@query(
    "read_json_change_set",
    """select change_id, cast(pos - 1 as bigint) as pos, files[pos] as filename from (select change_id, files, unnest(range(1, len(files) + 1)) as pos
    from (select change_id, from_json(json_extract(json, '$.files[*].filename'), '["VARCHAR"]') as files from change_json))""",
)
def _(v):
    return J.read_change_files(v("change_json"))


@query(
    "read_json_change_commits",
    """select change_id, json_extract_string(json, '$.commits[0].sha') as sha, cast(0 as bigint) as pos,
    coalesce(json_extract_string(json, '$.commits[0].commit.message'), '') as message from change_json""",
)
def _(v):
    return J.read_change_commits(v("change_json"))


@query("read_json_change_heads", "select change_id, json_extract_string(json, '$.head.ref') as head_branch from change_json")
def _(v):
    return J.read_change_heads(v("change_json"))


#: Change sets of which some are broken: by turns a branch that is a list, a number among the files,
#: commits below a key of their own, and text in front of the document.
STRANGE = """(select change_id, case change_id % 5
    when 1 then replace(json, '"head": {"ref": ', '"head": {"ref": [1], "was": ')
    when 2 then replace(json, '"files": [', '"files": [7, ')
    when 3 then concat(replace(json, '"commits": [', '"commits": {"all": ['), '}')
    when 4 then concat('x', json) else json end as json from change_json)"""


def strange_json(v):
    json, turn = F.col("json"), F.col("change_id") % 5
    return v("change_json").select(
        "change_id",
        F.when(turn == 1, F.replace(json, F.lit('"head": {"ref": '), F.lit('"head": {"ref": [1], "was": ')))
        .when(turn == 2, F.replace(json, F.lit('"files": ['), F.lit('"files": [7, ')))
        .when(turn == 3, F.concat(F.replace(json, F.lit('"commits": ['), F.lit('"commits": {"all": [')), F.lit("}")))
        .when(turn == 4, F.concat(F.lit("x"), json))
        .otherwise(json)
        .alias("json"),
    )


@query("rejected_documents", f"select change_id, json, 'malformed JSON' as reason from {STRANGE} where not json_valid(json)")
def _(v):
    return J.rejected_documents(strange_json(v))


def items_sql(field: str, *fields: tuple[str, str]) -> str:
    """Paths of the elements of an array, and below them, with the types they should have."""
    of = f"""(select change_id, json, unnest(range(cast(json_array_length(json, '$.{field}') as bigint))) as i
      from ok where json_type(json, '$.{field}') = 'ARRAY')"""
    below = [("", "OBJECT"), *((f".{name}", kind) for name, kind in fields)]
    return " union all ".join(
        f"select change_id, json, '$.{field}[' || i || ']{name}' as path, '{kind}' as expected from {of}" for name, kind in below
    )


@query(
    "mistyped_fields",
    f"""with ok as (select change_id, case when json_valid(json) then json end as json from {STRANGE}),
    paths as (select change_id, json, path, expected from ok, (values ('$.head', 'OBJECT'), ('$.head.ref', 'STRING'),
        ('$.commits', 'ARRAY'), ('$.files', 'ARRAY')) as f(path, expected)
      union all {items_sql('commits', ('sha', 'STRING'), ('commit', 'OBJECT'), ('commit.message', 'STRING'))}
      union all {items_sql('files', ('filename', 'STRING'))}),
    typed as (select change_id, path, expected, json_type(json, path) as t from paths)
    select change_id, path, expected, case t when 'VARCHAR' then 'STRING' when 'UBIGINT' then 'BIGINT' else t end as found from typed
    where t <> 'NULL' and case t when 'VARCHAR' then 'STRING' when 'UBIGINT' then 'BIGINT' else t end <> expected""",
)
def _(v):
    return J.mistyped_fields(strange_json(v))


@query(
    "read_json_result",
    """select event_id, coalesce(cast(json_extract_string(json, '$.should_run') as boolean), false) as should_run,
    coalesce(cast(json_extract_string(json, '$.scripts_written') as int), 0) as scripts_written,
    coalesce(cast(json_extract_string(json, '$.rollback_scripts_written') as int), 0) as rollback_scripts_written,
    coalesce(from_json(json_extract(json, '$.warnings'), '["VARCHAR"]'), []::varchar[]) as warnings,
    json_extract_string(json, '$.error') as error from result_json""",
)
def _(v):
    return J.read_change_set_result(v("result_json"), keep=("event_id",))


# --- templates ----------------------------------------------------------------------


@query(
    "render_named",
    """select event_id, template, user_id, event_type, replace(replace(template, '{user_id}', user_id), '{event_type}', event_type) as rendered from templates""",
)
def _(v):
    return M.render_named(v("templates"), ["user_id", "event_type"])


@query(
    "render_positional",
    "select event_id, template, user_id, event_type, replace(template, '{}', user_id) as rendered from templates",
)
def _(v):
    return M.render_positional(v("templates"), ["user_id", "event_type"])


PLACEHOLDER = r'\{(\w[^{"\r\n]*\w)\}'


@query(
    "extract_placeholders",
    f"select event_id, template, user_id, event_type, regexp_extract_all(template, '{PLACEHOLDER}', 1) as placeholders from templates",
)
def _(v):
    return M.extract_placeholders(v("templates"))


@query(
    "extract_placeholders_braces",
    f"select event_id, template, user_id, event_type, regexp_extract_all(template, '{PLACEHOLDER}', 0) as placeholders from templates",
)
def _(v):
    return M.extract_placeholders(v("templates"), keep_braces=True)


@query(
    "placeholder_usage",
    f"""select placeholder, count(*) as n_templates from (select unnest(list_distinct(regexp_extract_all(template, '{PLACEHOLDER}', 1))) as placeholder
    from templates) group by placeholder""",
)
def _(v):
    return M.placeholder_usage(v("templates"))
