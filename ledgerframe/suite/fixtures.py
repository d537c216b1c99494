"""Views derived from the given tables, as SQL text that Spark and DuckDB share.

``frame`` runs a view on Spark; ``with_views`` prefixes a check with the same text.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

STEM = """concat(cast(doc_id as string), '_', source,
  case doc_id % 8 when 1 then '_user' when 2 then '_rpt' when 3 then '_pkg' when 4 then '_perfstat'
                  when 5 then '_pkg_user' when 6 then '_pkg_rpt' else '' end"""
BODY = """concat('-- create table hidden', cast(doc_id as string), chr(13), chr(10),
  case doc_id % 10
    when 0 then concat('create or replace package body PKG_', cast(doc_id % 40 as string), ' as')
    when 1 then concat('create or replace package PKG_', cast(doc_id % 40 as string), ' as')
    when 2 then concat('CREATE TABLE ', chr(34), 'T', cast(doc_id % 40 as string), chr(34), '(id number);')
    when 3 then concat('create or replace force view V', cast(doc_id % 40 as string), ' as select 1')
    when 4 then concat('comment on column T', cast(doc_id % 40 as string), '.C is 1;')
    when 5 then concat('create unique index IX', cast(doc_id % 40 as string), ' on t(a);')
    when 6 then concat('create sequence SEQ_', cast(doc_id % 40 as string), ';')
    when 7 then concat('alter trigger TR_', cast(doc_id % 40 as string), ' enable;')
    when 8 then concat('drop type body TY_', cast(doc_id % 40 as string), ';')
    else concat('alter   table', chr(10), chr(10), 'T', cast(doc_id % 40 as string), ' add c number;') end,
  chr(10), '/* drop view gone */', chr(10), 'update log set msg = ''',
  replace(text, chr(39), ' '), ''';', chr(10))"""

VIEWS: dict[str, str] = {}

VIEWS["dir_scripts"] = f"""
select {STEM}, '.sql') as name, {BODY} as text from documents where doc_id % 11 <> 0
union all
select {STEM}, '_rollback.sql') as name, concat('-- undo', chr(10), {BODY}) as text from documents
 where doc_id % 3 = 0 and (doc_id % 11 <> 0 or doc_id % 231 = 0)
union all
select concat('dev', cast(doc_id as string), '_x.sql') as name, text from documents where doc_id % 50 = 7
"""
VIEWS["registry"] = f"""
select doc_id * 2 as script_id, {STEM}, '.sql') as name,
  concat({BODY}, case when doc_id % 7 = 0 then '-- older edition' else '' end) as text, 0 as type, 0 as status
from documents where doc_id % 13 <> 0
union all
select doc_id * 2 + 1 as script_id, {STEM}, '_rollback.sql') as name,
  concat('-- undo', chr(10), {BODY}) as text, 1 as type, 0 as status
from documents where doc_id % 13 <> 0 and doc_id % 3 = 0
"""
# The registry with every seventh script recorded twice, as before a unique key is enforced.
VIEWS["registry_log"] = """
select script_id, name, text, type, status from registry
union all
select script_id + 10000000 as script_id, name, concat(text, '-- again') as text, type, 2 as status
from registry where script_id % 7 = 0
union all
select script_id + 20000000 as script_id, name, text, type, status from registry where script_id % 21 = 0
"""
VIEWS["objects"] = """
select concat('APP', case p_partkey % 5 when 1 then '_USER' when 2 then '_PKG' when 3 then '_RPT' when 4 then '_ETL' else '' end) as owner,
  upper(concat(case p_partkey % 9 when 0 then 'Z_' when 1 then 'T$' when 2 then 'VX_' when 3 then 'PKGR_' else '' end,
    replace(p_name, ' ', '_'), '_', cast(p_partkey as string), case when p_partkey % 17 = 0 then '_OLD' else '' end)) as object_name,
  case p_size % 10 when 0 then 'TABLE' when 1 then 'VIEW' when 2 then 'PACKAGE' when 3 then 'PACKAGE BODY' when 4 then 'TRIGGER'
    when 5 then 'TYPE' when 6 then 'TYPE BODY' when 7 then 'SEQUENCE' when 8 then 'INDEX' else 'SYNONYM' end as object_type,
  case when p_partkey % 5 = 0 then 'Y' else 'N' end as generated,
  case when p_partkey % 4 = 0 then 'INVALID' else 'VALID' end as status
from part
"""
# The objects plus the tables and views that have a definition, some names being both.
VIEWS["catalog_objects"] = """
select owner, object_name, object_type, generated, status from objects
union all
select 'APP' as owner, object_name, object_type, 'N' as generated, 'VALID' as status from ddl_corpus
union all
select 'APP' as owner, concat('PKG_', cast(s_suppkey as string)) as object_name,
  case when s_suppkey % 2 = 0 then 'PACKAGE' else 'PACKAGE BODY' end as object_type, 'N' as generated, 'VALID' as status from supplier
union all
select 'APP' as owner, concat('T', cast(s_suppkey as string)) as object_name, 'VIEW' as object_type, 'N' as generated, 'VALID' as status
from supplier where s_suppkey % 6 = 0
"""
VIEWS["triggers"] = """
select concat('TR_', cast(o_orderkey as string)) as trigger_name, concat('T', cast(o_custkey as string)) as table_name from orders
"""
VIEWS["dependencies"] = """
select concat('TR_', cast(l_orderkey as string)) as name, 'TRIGGER' as type,
  case when l_linenumber % 2 = 0 then 'SEQUENCE' else 'TABLE' end as referenced_type,
  concat('SEQ_', cast(l_partkey as string)) as referenced_name from lineitem
"""
VIEWS["indexes"] = """
select concat('T', cast(l_suppkey as string)) as table_name,
  concat(case l_linenumber % 4 when 0 then 'PK_' when 1 then 'IX' when 2 then 'UX' else '' end, cast(l_orderkey as string), '_', cast(l_linenumber as string), '_', cast(l_partkey as string)) as index_name,
  case when l_linenumber % 4 = 2 then 'UNIQUE' else 'NONUNIQUE' end as uniqueness,
  case when l_returnflag = 'R' then 'ENABLED' else 'DISABLED' end as compression,
  l_linenumber as prefix_length, case when l_linestatus = 'F' then 'N' else 'Y' end as generated from lineitem
"""
VIEWS["index_ddl"] = """
select table_name, index_name, uniqueness, compression, prefix_length, generated,
  concat(chr(10), '  CREATE ', case when uniqueness = 'UNIQUE' then 'UNIQUE ' else '' end, 'INDEX ', chr(34), 'APP', chr(34), '.', chr(34), index_name, chr(34),
    ' ON ', chr(34), 'APP', chr(34), '.', chr(34), table_name, chr(34), ' (', chr(34), 'C', chr(34), ')', chr(10), '  ;') as ddl from indexes
"""
VIEWS["run_log"] = """
select user_id as run_id, event_id as step_id, ts, case when event_type = 'error' then 1 else 0 end as exit_code, value as seconds from events
"""
# Exit codes of script runs: a script fails when the event of its number is a long error.
VIEWS["outcomes"] = f"""
select {STEM}, '.sql') as name, case when event_type = 'error' and value > 30 then 1 else 0 end as exit_code
from documents join events on event_id = doc_id
union all
select {STEM}, '_rollback.sql') as name, case when event_type = 'error' and value > 45 then 1 else 0 end as exit_code
from documents join events on event_id = doc_id
"""
VIEWS["change_files"] = """
select page_id % 20 as change_id, page_id as pos,
  case page_id % 6 when 0 then concat('db/scripts/', cast(page_id as string), '_br_pkg', cast(page_id % 7 as string), '.sql')
    when 1 then concat('db/scripts/', cast(page_id as string), '_br_pkg', cast(page_id % 7 as string), '_rollback.sql')
    when 2 then concat('db/ddl/packages/PKG', cast(page_id % 7 as string), '_spec.sql')
    when 3 then concat('db/ddl/packages/pkg', cast(page_id % 7 as string), '.sql')
    when 4 then concat('db/ddl/tables/t', cast(page_id as string), '.sql')
    else concat('src/', cast(page_id as string), '.java') end as filename from pages
"""
VIEWS["commits"] = """
select conv_id % 20 as change_id, concat(cast(conv_id as string), ':', cast(turn as string)) as sha, turn as pos,
  case when turn % 3 = 2 then concat('Merge branch ''master'' into b', cast(conv_id as string)) else text end as message from conversations
"""
# One change-set document per page, with two files and one commit.
VIEWS["change_json"] = """
select page_id as change_id, concat('{"head": {"ref": "branch', cast(page_id % 9 as string), '"}, "files": [{"filename": "db/scripts/', cast(page_id as string),
  '_a_b.sql"}, {"filename": "', replace(replace(url, chr(92), '/'), chr(34), ''), '"}], "commits": [{"sha": "', cast(page_id * 7 as string), '"',
  case when page_id % 3 = 0 then '' else concat(', "commit": {"message": "fix ', cast(page_id as string), '"}') end, '}]}') as json from pages
"""
VIEWS["result_json"] = """
select event_id, concat('{', case when event_type = 'error' then concat('"error": "code ', cast(user_id as string), '"')
    when event_type = 'view' then '"should_run": true, "renamed": 0'
    when event_type = 'click' then concat('"scripts_written": ', cast(user_id as string), ', "warnings": ["w', cast(event_id as string), '", "x"]')
    else concat('"should_run": false, "error": null, "rollback_scripts_written": ', cast(user_id % 5 as string)) end, '}') as json from events
"""
VIEWS["fragments"] = """
select conv_id as parent_id, role as kind, turn as ord, text from conversations
"""
VIEWS["templates"] = """
select event_id, concat('user {user_id} did {event_type}, {unknown} left, step {}') as template,
  cast(user_id as string) as user_id, event_type from events
"""
VIEWS["package_sources"] = """
select 'before' as edition, concat('pkg', cast(doc_id as string)) as package_name,
  concat('package pkg', cast(doc_id as string), ' -- (c) 2003-2019', chr(10), 'as', chr(10), case when doc_id % 2 = 0 then '/' else 'end;' end, '  ', chr(10)) as spec,
  case when doc_id <> 3 then concat('package body pkg', cast(doc_id as string), ' ', text, chr(10), '/', chr(10), '  ') end as body
from documents
union all
select 'after' as edition, concat('pkg', cast(doc_id as string)) as package_name,
  concat('package pkg', cast(doc_id as string), ' -- (c) 2003-2021', chr(10), 'as v2', chr(10), '/', chr(10)) as spec,
  case when doc_id <> 3 then concat('package body pkg', cast(doc_id as string), ' v2 ', text, chr(10), '/') end as body
from documents
"""
VIEWS["ddl_corpus"] = """
select concat('T', cast(p_partkey as string)) as object_name, 'TABLE' as object_type,
  concat(chr(10), '  CREATE TABLE ', chr(34), 'APP', chr(34), '.', chr(34), 'T', cast(p_partkey as string), chr(34), ' ', chr(10), '   (', chr(9),
    chr(34), 'ID', chr(34), ' NUMBER NOT NULL ENABLE, ', chr(10), chr(9),
    chr(34), 'NAME', chr(34), ' VARCHAR2(20) DEFAULT ', chr(39), p_name, chr(34), 'q', chr(34), chr(39), ', ', chr(10), chr(9),
    ' CONSTRAINT ', chr(34), 'FK10_T', chr(34), ' FOREIGN KEY (', chr(34), 'A', chr(34), ')', chr(10), chr(9), '  REFERENCES ', chr(34), 'APP', chr(34), '.', chr(34), 'P', chr(34), ' ENABLE, ', chr(10), chr(9),
    ' CONSTRAINT ', chr(34), 'FK2_T', chr(34), ' FOREIGN KEY (', chr(34), 'B', chr(34), ')', chr(10), chr(9), '  REFERENCES ', chr(34), 'APP', chr(34), '.', chr(34), 'Q', chr(34), ' ENABLE, ', chr(10), chr(9),
    ' CONSTRAINT ', chr(34), 'PK_T', chr(34), ' PRIMARY KEY (', chr(34), 'ID', chr(34), ')', chr(10), '  USING INDEX  ENABLE', chr(10), '   ) ;') as ddl
from part where p_partkey % 2 = 0
union all
select concat('V', cast(p_partkey as string)) as object_name, 'VIEW' as object_type,
  concat('  CREATE OR REPLACE FORCE EDITIONABLE VIEW ', chr(34), 'APP', chr(34), '.', chr(34), 'V', cast(p_partkey as string), chr(34), ' AS', chr(10),
    'select ', chr(34), 'X', chr(34), ' /* keep ', chr(34), 'k', chr(34), ' */ from t -- ', chr(34), p_brand, chr(34), chr(10), ' where n = ', chr(39), p_name, chr(34), chr(39), ' ;') as ddl
from part where p_partkey % 2 = 1
"""
# Package and type text: long bodies taken from the documents.
VIEWS["program_ddl"] = """
select concat('PKG_', cast(doc_id as string)) as object_name,
  case doc_id % 4 when 0 then 'PACKAGE' when 1 then 'PACKAGE BODY' when 2 then 'TYPE' else 'TYPE BODY' end as object_type,
  concat('  CREATE OR REPLACE NONEDITIONABLE PACKAGE ', chr(34), 'APP', chr(34), '.', chr(34), 'PKG_', cast(doc_id as string), chr(34), ' AS', chr(10), text, chr(10), 'end;', chr(10), '  /') as ddl
from documents
"""
# An older copy of the stored definitions: some missing, some changed, some left over.
VIEWS["stored_ddl"] = """
select object_name, object_type,
  case when length(object_name) % 2 = 0 then concat(ddl, '-- old') else ddl end as ddl
from ddl_corpus where object_name not like '%7'
union all
select concat('GONE', cast(s_suppkey as string)) as object_name, 'TABLE' as object_type, 'x' as ddl from supplier
"""
VIEWS["col_comments"] = """
select concat('T', cast(p_partkey % 100 as string)) as table_name, concat('C', cast(p_partkey as string), p_type) as column_name,
  case when p_partkey % 3 <> 0 then p_name end as comments from part
"""
# Comments on views as well as tables.
VIEWS["all_col_comments"] = """
select table_name, column_name, comments from col_comments
union all
select concat('V', cast(p_partkey % 100 as string)) as table_name, concat('C', cast(p_partkey as string), p_brand) as column_name, p_name as comments from part
"""
VIEWS["all_tab_comments"] = """
select table_name, comments from tab_comments
union all
select concat('V', cast(s_suppkey as string)) as table_name, s_name as comments from supplier
"""
VIEWS["tab_comments"] = """
select concat('T', cast(s_suppkey as string)) as table_name, case when s_suppkey % 4 <> 0 then s_name end as comments from supplier
"""
VIEWS["sequence_ddl"] = """
select concat('T', cast(l_suppkey as string)) as table_name, concat('SEQ_', cast(l_partkey as string)) as sequence_name,
  concat(chr(10), '   CREATE SEQUENCE  ', chr(34), 'APP', chr(34), '.', chr(34), case when l_partkey % 10 = 0 then 'SEQ_BPD_ITEMS_UNIT_ID' else 'SEQ_' end,
    cast(l_partkey as string), chr(34), '  MINVALUE 1 INCREMENT BY 1  NOCYCLE ;') as ddl
from (select distinct l_suppkey, l_partkey from lineitem) as used
"""
VIEWS["trigger_ddl"] = """
select table_name, trigger_name, concat('  CREATE OR REPLACE EDITIONABLE TRIGGER ', chr(34), 'APP', chr(34), '.', chr(34), trigger_name, chr(34),
  ' before insert on ', chr(34), 'APP', chr(34), '.', chr(34), table_name, chr(34), chr(10), 'begin', chr(10), '  null;', chr(10), 'end;', chr(10), '   /', chr(10),
  'ALTER TRIGGER ', chr(34), 'APP', chr(34), '.', chr(34), trigger_name, chr(34), ' ENABLE;') as ddl from triggers
"""
VIEWS["requests"] = """
select lower(object_name) as object_name,
  case object_type when 'PACKAGE' then 'PACKAGE_SPEC' when 'PACKAGE BODY' then 'PACKAGE_BODY' when 'TYPE' then 'TYPE_SPEC'
    when 'TYPE BODY' then 'TYPE_BODY' else object_type end as object_type from objects
union all
select lower(concat(object_name, '_gone')) as object_name, 'TABLE' as object_type from objects
union all
select ' ' as object_name, 'TABLE' as object_type from supplier
"""

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def needed(text: str) -> list[str]:
    """Views a text refers to, directly or through others, in definition order."""
    found: set[str] = set()
    queue = [text]
    while queue:
        words = set(re.findall(r"(?:from|join)\s+(\w+)", queue.pop()))
        for view in words & set(VIEWS) - found:
            found.add(view)
            queue.append(VIEWS[view])
    return _sorted_by_use(found)


def _sorted_by_use(found: set[str]) -> list[str]:
    done: list[str] = []

    def add(view: str) -> None:
        if view in done:
            return
        for used in re.findall(r"(?:from|join)\s+(\w+)", VIEWS[view]):
            if used in VIEWS:
                add(used)
        done.append(view)

    for view in VIEWS:
        if view in found:
            add(view)
    return done


def with_views(check: str) -> str:
    """``check`` with the views it reads in front; a leading ``with`` is merged."""
    ctes = [f"{v} as ({VIEWS[v]})" for v in needed(check)]
    body = check.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ",\n" + body[5:] if ctes else body
    return "with " + ", ".join(ctes) + "\n" + body if ctes else body


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A derived view, or a given table, as a DataFrame."""
    if view in TABLES:
        return spark.table(table_view(spark, sf_dir, view))
    tables = "|".join(TABLES)
    text = with_views(f"select * from {view}")
    grown = {"part"} if "ddl_corpus" in needed(f"select * from {view}") else set()
    located = re.sub(
        rf"\b(from|join)\s+({tables})\b",
        lambda m: f"{m[1]} {table_view(spark, sf_dir, m[2], m[2] in grown)}",
        text,
    )
    return spark.sql(located)


def table_view(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> str:
    """A temporary view of one given table; its schema is looked up once per session.

    A table of few bytes, whose rows become long definitions, is read by one or two tasks, which then
    do all work on the definitions; ``spread`` deals its rows over all cores first.
    """
    name = f"given_{zlib.crc32(sf_dir.encode()):08x}_{table}" + ("_spread" if spread else "")
    if not spark.catalog.tableExists(name):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism) if spread else rows
        rows.createOrReplaceTempView(name)
    return name
