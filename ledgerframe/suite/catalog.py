"""Catalogue queries and change resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.operators import catalog as C
from ledgerframe.operators import impact as I
from ledgerframe.suite import sqltext as S
from ledgerframe.suite.registry import query

OWNER = "APP"
OWN_INDEX = "generated = 'N' and index_name not like 'PK_%'"
LEAD = r"nullif(regexp_extract(index_name, '^\D*'), '')"
NUMBER = r"try_cast(nullif(regexp_extract(index_name, '\d+'), '') as decimal(38,0))"
COMPILABLE = (
    "status <> 'VALID' and object_type in ('TRIGGER', 'PROCEDURE', 'FUNCTION', 'PACKAGE', 'PACKAGE BODY', "
    "'TYPE', 'TYPE BODY', 'INDEX', 'VIEW', 'SYNONYM')"
)


def listed(view: str) -> str:
    """The owner's objects that have a stored definition."""
    return f"""select object_name, object_type from {view} where owner = 'APP' and ((object_type = 'TABLE' and generated = 'N' and object_name not like 'Z_%'
    and object_name not like '%_OLD') or object_type in ('VIEW', 'PACKAGE', 'PACKAGE BODY', 'TRIGGER')
    or (object_type in ('TYPE', 'TYPE BODY') and generated = 'N' and object_name not like 'T$%'))"""


@query("list_objects", listed("objects"))
def _(v):
    return C.list_objects(v("objects"), OWNER)


FOUND = f"""trim(q.object_name) <> '' and exists (select 1 from objects o
    where o.owner = 'APP' and o.object_name = upper(q.object_name) and o.object_type = {S.catalogue_type('q.object_type')})"""


@query(
    "object_exists",
    f"select object_name, object_type, {FOUND} as found from (select distinct object_name, object_type from requests) q",
)
def _(v):
    return C.object_exists(v("requests"), v("objects"), OWNER)


@query(
    "object_kind",
    """select object_name, case when hits = 0 then 'missing' when hits > 1 then 'ambiguous' else kind end as kind from
    (select q.object_name, count(o.object_name) as hits, max(o.object_type) as kind
     from (select distinct object_name from requests union select lower(object_name) from catalog_objects) q
     left join (select * from catalog_objects where owner = 'APP' and object_type in ('TABLE', 'VIEW')) o on o.object_name = upper(q.object_name) group by q.object_name)""",
)
def _(v):
    catalogue = v("catalog_objects")
    names = v("requests").select("object_name").union(catalogue.select(F.lower("object_name")))
    return C.object_kind(names, catalogue, OWNER)


def changed_of(v, kind: str):
    return I.distinct_changed_objects(v("dir_scripts")).where(F.col("object_type") == kind).select("object_name")


CHANGED = f"select distinct object_name, object_type from ({S.changed()})"


@query(
    "parent_by_index",
    f"""select q.object_name, i.table_name from (select lower(index_name) as object_name from indexes
      union select object_name from ({CHANGED}) where object_type = 'INDEX') q left join indexes i on i.index_name = upper(q.object_name)""",
)
def _(v):
    indexes = v("indexes")
    names = indexes.select(F.lower("index_name").alias("object_name")).union(changed_of(v, "INDEX"))
    return C.parent_by_index(names, indexes)


@query(
    "parent_by_trigger",
    f"""select q.object_name, t.table_name from (select lower(trigger_name) as object_name from triggers
      union select object_name from ({CHANGED}) where object_type = 'TRIGGER') q left join triggers t on t.trigger_name = upper(q.object_name)""",
)
def _(v):
    triggers = v("triggers")
    names = triggers.select(F.lower("trigger_name").alias("object_name")).union(changed_of(v, "TRIGGER"))
    return C.parent_by_trigger(names, triggers)


USES = """select distinct t.table_name, d.referenced_name as sequence_name from dependencies d join triggers t on t.trigger_name = d.name
    where d.type = 'TRIGGER' and d.referenced_type = 'SEQUENCE'"""


@query(
    "parent_by_sequence",
    f"""select object_name, table_name, count(table_name) over (partition by object_name) as n_tables
    from (select distinct object_name, table_name from
      (select lower(referenced_name) as object_name from dependencies union select object_name from ({CHANGED}) where object_type = 'SEQUENCE') q
      left join ({USES}) u on u.sequence_name = upper(q.object_name))""",
)
def _(v):
    dependencies = v("dependencies")
    names = dependencies.select(F.lower("referenced_name").alias("object_name")).union(changed_of(v, "SEQUENCE"))
    return C.parent_by_sequence(names, dependencies, v("triggers"))


@query("table_sequences", USES)
def _(v):
    return C.table_sequences(v("dependencies"), v("triggers"))


@query(
    "table_indexes",
    f"""select table_name, index_name, uniqueness, {LEAD} as lead, {NUMBER} as number,
    case when compression = 'ENABLED' then 1 else 0 end as compressed, prefix_length from indexes where {OWN_INDEX}""",
)
def _(v):
    return C.table_indexes(v("indexes"))


@query(
    "table_triggers",
    "select table_name, trigger_name, lower(trigger_name) as sort_name from triggers where trigger_name not like 'Z_%'",
)
def _(v):
    return C.table_triggers(v("triggers"))


@query(
    "commented_tables",
    "select table_name from tab_comments where comments is not null union select table_name from col_comments where comments is not null",
)
def _(v):
    return C.commented_tables(v("tab_comments"), v("col_comments"))


def resolution(changed: str) -> str:
    """What a query's changed objects stand for."""
    return f"""with c as ({changed}), cat as (select distinct object_name, object_type from catalog_objects where owner = 'APP'),
    kinds as (select object_name, count(*) as hits, max(object_type) as kind from catalog_objects where owner = 'APP' and object_type in ('TABLE', 'VIEW') group by object_name),
    dep as (select c.object_name, c.object_type, i.table_name from c left join indexes i on i.index_name = upper(c.object_name) where c.object_type = 'INDEX'
      union all select c.object_name, c.object_type, t.table_name from c left join triggers t on t.trigger_name = upper(c.object_name) where c.object_type = 'TRIGGER'),
    placed as (select d.*, t.object_name is not null as ok from dep d left join cat t on t.object_name = d.table_name and t.object_type = 'TABLE')
    select distinct lower(target_name) as target_name, target_type, action from (
      select case when ok then table_name else object_name end as target_name, case when ok then 'TABLE' else object_type end as target_type,
        case when ok then 'regenerate' else 'unresolved' end as action from placed
      union all
      select coalesce(u.table_name, c.object_name), case when u.table_name is null then 'SEQUENCE' else 'TABLE' end,
        case when u.table_name is null then 'unresolved' else 'regenerate' end
      from c left join ({USES}) u on u.sequence_name = upper(c.object_name) where c.object_type = 'SEQUENCE'
      union all
      select c.object_name, case when hits = 1 then kind else 'COMMENT' end, case when hits = 1 then 'regenerate' else 'unresolved' end
      from c left join kinds k on k.object_name = upper(c.object_name) where c.object_type = 'COMMENT'
      union all
      select c.object_name, c.object_type, case when o.object_name is null then 'redundant' else 'regenerate' end
      from c left join cat o on o.object_name = upper(c.object_name) and o.object_type = {S.catalogue_type('c.object_type')}
      where c.object_type in ('PACKAGE_BODY', 'PACKAGE_SPEC', 'TABLE', 'VIEW', 'TYPE_BODY', 'TYPE_SPEC'))"""


RESOLVED = resolution(CHANGED)


@query("resolve_changed_objects", RESOLVED)
def resolved(v):
    changed = I.distinct_changed_objects(v("dir_scripts"))
    return C.resolve_changed_objects(
        changed, v("catalog_objects"), v("indexes"), v("triggers"), v("dependencies"), OWNER
    )


@query(
    "redundant_artifacts",
    f"""with gone as (select object_name, object_type from (select distinct object_name, object_type from requests
        union select object_name, object_type from ({CHANGED})) q
      where object_type in ('PACKAGE_BODY', 'PACKAGE_SPEC', 'TABLE', 'VIEW', 'TYPE_BODY', 'TYPE_SPEC') and not ({FOUND}))
    select object_name, object_type, {S.artifact_path('object_name', 'object_type')} as path from gone
    union all select object_name, object_type, {S.artifact_path('object_name', "replace(object_type, '_SPEC', '_BODY')")} as path
    from gone where object_type in ('PACKAGE_SPEC', 'TYPE_SPEC')""",
)
def _(v):
    asked = v("requests").unionByName(I.distinct_changed_objects(v("dir_scripts")))
    return C.redundant_artifacts(asked, v("objects"), OWNER)


@query(
    "excluded_objects",
    """select object_name, object_type from objects where (object_type in ('PACKAGE', 'PACKAGE BODY') and starts_with(upper(object_name), 'PKGR_'))
    or (object_type = 'VIEW' and starts_with(upper(object_name), 'VX_')) or (object_type = 'SEQUENCE' and contains(upper(object_name), 'SEQ_BPD_ITEMS_UNIT_ID'))""",
)
def _(v):
    return C.excluded_objects(v("objects"))


@query("artifact_path", f"select object_name, object_type, {S.artifact_path('object_name', 'object_type')} as path from objects")
def _(v):
    return C.artifact_paths(v("objects"))


@query(
    "invalid_objects",
    """select owner, object_type, object_name from objects where status = 'INVALID' and object_name not like 'BIN$%'
    and object_type <> 'SYNONYM' and owner in ('APP', 'APP_USER', 'APP_PKG', 'APP_RPT')""",
)
def _(v):
    return C.invalid_objects(v("objects"), OWNER)


@query(
    "invalid_summary",
    f"select owner, object_type, count(*) as n_invalid from objects where {COMPILABLE} group by rollup (owner, object_type)",
)
def _(v):
    return C.invalid_summary(v("objects"))


@query(
    "compile_statements",
    f"""select owner, object_name, object_type, case object_type when 'PACKAGE' then 'alter package ' || object_name || ' compile specification'
    when 'PACKAGE BODY' then 'alter package ' || object_name || ' compile body' when 'TYPE' then 'alter type ' || object_name || ' compile specification'
    when 'TYPE BODY' then 'alter type ' || object_name || ' compile body' when 'INDEX' then 'alter index ' || object_name || ' rebuild'
    when 'SYNONYM' then 'select 1 from ' || object_name else 'alter ' || lower(object_type) || ' ' || object_name || ' compile' end as statement
    from objects where owner = 'APP' and {COMPILABLE}""",
)
def _(v):
    return C.compile_statements(v("objects"), OWNER)


@query(
    "present_schemas",
    "select distinct owner as username from objects where owner in ('APP_USER', 'APP_RPT', 'APP_PKG')",
)
def _(v):
    return C.present_schemas(OWNER, v("objects").select(F.col("owner").alias("username")))
