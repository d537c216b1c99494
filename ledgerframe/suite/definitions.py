"""Definition text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.operators import catalog as C
from ledgerframe.operators import definitions as D
from ledgerframe.operators import impact as I
from ledgerframe.plans import definitions as P
from ledgerframe.suite import sqltext as S
from ledgerframe.suite.catalog import RESOLVED, listed, resolution, resolved
from ledgerframe.suite.registry import query

OWNER = "APP"


def rule(name: str, operator, sql: str, view: str = "ddl_corpus", where: str = "true") -> None:
    @query(name, f"select object_name, object_type, {sql} as ddl from {view} where {where}")
    def _(v):
        return operator(v(view).where(where))


rule("strip_schema", lambda d: D.strip_schema(d, OWNER), S.strip_schema("ddl"))
rule("strip_editionable", D.strip_editionable, "replace(replace(ddl, 'NONEDITIONABLE ', ''), 'EDITIONABLE ', '')")
rule("unquote_identifiers", D.unquote_identifiers, S.unquoted("ddl"))
rule(
    "canonical_package",
    lambda d: D.canonical_package(d, OWNER),
    S.canonical_package("ddl"),
    "program_ddl",
    "object_type in ('PACKAGE', 'PACKAGE BODY')",
)
rule(
    "canonical_type",
    lambda d: D.canonical_type(d, OWNER),
    S.canonical_package("ddl"),
    "program_ddl",
    "object_type in ('TYPE', 'TYPE BODY')",
)
rule(
    "canonical_view", lambda d: D.canonical_view(d, OWNER), S.canonical_view("ddl"), "ddl_corpus", "object_type = 'VIEW'"
)

TABLES_ONLY = "select object_name, object_type, ddl from ddl_corpus where object_type = 'TABLE'"
UNSORTED = f"select object_name, object_type, {S.canonical_table_unsorted('ddl')} as ddl from ddl_corpus where object_type = 'TABLE'"


@query("sort_constraints", S.sorted_constraints(TABLES_ONLY))
def _(v):
    return D.sort_constraints(v("ddl_corpus").where("object_type = 'TABLE'"))


@query("canonical_table", S.sorted_constraints(UNSORTED))
def _(v):
    return D.canonical_table(v("ddl_corpus").where("object_type = 'TABLE'"), OWNER)


def canonical_check(source: str) -> str:
    """CTE body: the stored form of a corpus of tables, views and programs."""
    unsorted = f"select object_name, object_type, {S.canonical_table_unsorted('ddl')} as ddl from {source} where object_type = 'TABLE'"
    return f"""select object_name, object_type, {S.code_style('ddl')} as ddl from (
      {S.sorted_constraints(unsorted)}
      union all select object_name, object_type, {S.canonical_view('ddl')} as ddl from {source} where object_type = 'VIEW'
      union all select object_name, object_type, {S.canonical_package('ddl')} as ddl from {source} where object_type not in ('TABLE', 'VIEW'))"""


@query("canonical_corpus", f"select * from ({canonical_check('ddl_corpus')} union all {canonical_check('program_ddl')})")
def _(v):
    return D.canonical(v("ddl_corpus").unionByName(v("program_ddl")), OWNER)


@query(
    "number_aware_key",
    f"""select index_name, {S.letters('index_name')} as letters, cast(length({S.digits('index_name')}) as int) as digit_count,
    {S.digits('index_name')} as digits from (select index_name from indexes union all select column_name from col_comments)""",
)
def _(v):
    names = v("indexes").select("index_name").union(v("col_comments").select("column_name"))
    return D.number_aware_order(names, "index_name")


def comment_rows(prefix: str = "") -> str:
    tabs, cols = f"{prefix}tab_comments", f"{prefix}col_comments"
    return f"""select table_name, 0 as rank, '' as letters, 0 as digit_count, '' as digits, '' as column_name, {S.CRLF} as text
      from (select table_name from {tabs} where comments is not null union select table_name from {cols} where comments is not null)
    union all select table_name, 1, '', 0, '', '', {S.CRLF} || {S.comment('table_name', None, 'comments')} from {tabs} where comments is not null
    union all select table_name, 2, {S.letters('column_name')}, length({S.digits('column_name')}), {S.digits('column_name')}, column_name,
      {S.CRLF} || {S.comment('table_name', 'column_name', 'comments')} from {cols} where comments is not null"""


COMMENT_ORDER = "rank, letters, digit_count, digits, column_name"


@query(
    "table_comment_text",
    f"""select table_name, cast(0 as bigint) as part, string_agg(text, '' order by {COMMENT_ORDER}) as text
    from ({comment_rows()}) group by table_name""",
)
def _(v):
    return D.table_comment_text(v("tab_comments"), v("col_comments"))


INDEX_ORDER = (
    r"uniqueness desc, nullif(regexp_extract(index_name, '^\D*'), '') nulls first, "
    r"try_cast(nullif(regexp_extract(index_name, '\d+'), '') as decimal(38,0)) nulls last, index_name"
)
OWN_INDEX = "generated = 'N' and index_name not like 'PK_%'"
INDEX_TEXT = f"""select table_name, {S.CRLF} || string_agg({S.CRLF} || {S.index_statement('ddl')}, '' order by {INDEX_ORDER}) as text
    from index_ddl where {OWN_INDEX} group by table_name"""


@query("index_text", f"select table_name, cast(0 as bigint) as part, text from ({INDEX_TEXT})")
def _(v):
    return D.index_text(v("index_ddl"), OWNER)


@query(
    "sequence_text",
    f"select sequence_name, {S.sequence_statement('ddl')} as text from sequence_ddl where not contains(ddl, 'SEQ_BPD_ITEMS_UNIT_ID')",
)
def _(v):
    return D.sequence_text(v("sequence_ddl"), OWNER)


@query("trigger_text", f"select table_name, trigger_name, {S.trigger_statement('ddl')} as text from trigger_ddl")
def _(v):
    return D.trigger_text(v("trigger_ddl"), OWNER)


ROLES = ("system", "user", "assistant", "tool")


@query(
    "assemble_documents",
    f"""select parent_id, cast(0 as bigint) as part,
    string_agg(text, '' order by coalesce(list_position({list(ROLES)!r}, kind), 99), kind, ord, text) as text from fragments group by parent_id""",
)
def _(v):
    return D.assemble_documents(v("fragments"), ROLES)


def table_doc_ctes(prefix: str = "") -> str:
    return f"""base as ({S.sorted_constraints(UNSORTED)}), idx as ({INDEX_TEXT}),
    com as (select table_name, string_agg(text, '' order by {COMMENT_ORDER}) as text from ({comment_rows(prefix)}) group by table_name),
    seq as (select table_name, string_agg({S.sequence_statement('ddl')}, '' order by sequence_name) as text from sequence_ddl
      where not contains(ddl, 'SEQ_BPD_ITEMS_UNIT_ID') group by table_name),
    trg as (select table_name, {S.CRLF} || string_agg({S.trigger_statement('ddl')}, '' order by lower(trigger_name), trigger_name) as text
      from trigger_ddl where trigger_name not like 'Z_%' group by table_name),
    tdoc as (select object_name, concat(base.ddl, idx.text, com.text, seq.text, trg.text) as text from base left join idx on idx.table_name = object_name
      left join com on com.table_name = object_name left join seq on seq.table_name = object_name left join trg on trg.table_name = object_name),
    vdoc as (select object_name, concat({S.canonical_view('ddl')}, com.text) as text from ddl_corpus left join com on com.table_name = object_name
      where object_type = 'VIEW' and not starts_with(upper(object_name), 'VX_'))"""


@query(
    "table_documents",
    f"with {table_doc_ctes()} select object_name, cast(0 as bigint) as part, {S.code_style('text')} as text from tdoc",
)
def _(v):
    return D.table_documents(
        v("ddl_corpus"),
        v("index_ddl"),
        v("tab_comments"),
        v("col_comments"),
        v("sequence_ddl"),
        v("trigger_ddl"),
        OWNER,
    )


@query(
    "view_documents",
    f"with {table_doc_ctes('all_')} select object_name, cast(0 as bigint) as part, {S.code_style('text')} as text from vdoc",
)
def _(v):
    return D.view_documents(v("ddl_corpus"), v("all_tab_comments"), v("all_col_comments"), OWNER)


ALL_FILES = f"""select 'tables/' || lower(object_name) || '.sql' as path, 'TABLE' as object_type, object_name, text from tdoc
      union all select 'views/' || lower(object_name) || '.sql', 'VIEW', object_name, text from vdoc
      union all select {S.artifact_path('object_name', 'object_type')}, object_type, object_name, {S.canonical_package('ddl')} from program_ddl"""


def all_definitions(v, targets=None):
    return P.definition_files(
        v("ddl_corpus").unionByName(v("program_ddl")),
        v("index_ddl"),
        v("all_tab_comments"),
        v("all_col_comments"),
        v("sequence_ddl"),
        v("trigger_ddl"),
        OWNER,
        targets,
    )


@query(
    "definition_files",
    f"with {table_doc_ctes('all_')} select path, cast(0 as bigint) as part, {S.code_style('text')} as text from ({ALL_FILES})",
)
def _(v):
    return all_definitions(v)


@query(
    "regenerated_definitions",
    f"""with {table_doc_ctes('all_')}, changed as (select distinct upper(target_name) as object_name, {S.catalogue_type('target_type')} as object_type
      from ({RESOLVED}) where action = 'regenerate')
    select path, cast(0 as bigint) as part, {S.code_style('text')} as text from ({ALL_FILES}) f
    where exists (select 1 from changed c where c.object_name = upper(f.object_name) and c.object_type = f.object_type)""",
)
def _(v):
    targets = resolved(v).where("action = 'regenerate'")
    return all_definitions(v, targets.select(F.col("target_name").alias("object_name"), F.col("target_type").alias("object_type")))


#: Forward owner scripts in development, or whose text differs from the registry's.
CANDIDATES = f"""select d.name from dir_scripts d left join registry r on r.name = d.name
    where {S.valid('d.name')} and {S.type_('d.name')} = 0 and {S.schema('d.name')} = 'OWNER'
    and ({S.order_number('d.name')} < 100 or {S.fingerprint('d.text')} <> {S.fingerprint('r.text')})"""


@query(
    "candidate_objects",
    f"select distinct object_name, object_type from ({S.changed('dir_scripts', f'where name in ({CANDIDATES})')})",
)
def _(v):
    return I.candidate_objects(v("dir_scripts"), v("registry"))


@query(
    "candidate_definitions",
    f"""with {table_doc_ctes('all_')}, changed as (select distinct upper(target_name) as object_name, {S.catalogue_type('target_type')} as object_type
      from ({resolution(f"select distinct object_name, object_type from ({S.changed('dir_scripts', f'where name in ({CANDIDATES})')})")}) where action = 'regenerate')
    select path, cast(0 as bigint) as part, {S.code_style('text')} as text from ({ALL_FILES}) f
    where exists (select 1 from changed c where c.object_name = upper(f.object_name) and c.object_type = f.object_type)""",
)
def _(v):
    return all_definitions(
        v,
        P.regeneration_targets(
            v("dir_scripts"), v("registry"), v("catalog_objects"), v("indexes"), v("triggers"), v("dependencies"), OWNER
        ),
    )


@query(
    "full_definitions",
    f"""with {table_doc_ctes('all_')}, listed as (select distinct upper(object_name) as object_name, {S.catalogue_type('object_type')} as object_type
      from ({listed('catalog_objects')}))
    select path, cast(0 as bigint) as part, {S.code_style('text')} as text from ({ALL_FILES}) f
    where exists (select 1 from listed c where c.object_name = upper(f.object_name) and c.object_type = {S.catalogue_type('f.object_type')})""",
)
def _(v):
    return all_definitions(v, C.list_objects(v("catalog_objects"), OWNER))


@query(
    "corpus_drift",
    f"""with s as (select {S.artifact_path('object_name', 'object_type')} as path, ddl from ({canonical_check('stored_ddl')})),
    c as (select {S.artifact_path('object_name', 'object_type')} as path, ddl from ({canonical_check('ddl_corpus')}))
    select path, case when s.ddl is null then 'create' when c.ddl is null then 'delete' else 'overwrite' end as action
    from s full join c using (path) where s.ddl is null or c.ddl is null or s.ddl <> c.ddl""",
)
def _(v):
    stored = D.stored_definitions(D.canonical(v("stored_ddl"), OWNER))
    current = D.stored_definitions(D.canonical(v("ddl_corpus"), OWNER))
    return D.corpus_drift(stored, current)
