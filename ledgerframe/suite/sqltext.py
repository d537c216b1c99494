"""SQL expressions of the rules, for the checks only. Written for DuckDB."""

from __future__ import annotations

from ledgerframe.functions import text as T

CRLF = "chr(13) || chr(10)"


def base(n: str) -> str:
    return rf"regexp_replace({n}, '\.[^.]*$', '')"


def ext(n: str) -> str:
    return f"case when contains({n}, '.') then regexp_extract({n}, '[^.]*$') else '' end"


def valid(n: str) -> str:
    return f"regexp_matches({n}, '^[0-9]+_+[^_]')"


def order_number(n: str) -> str:
    return f"try_cast(nullif(regexp_extract({n}, '^([0-9]+)(_|$)', 1), '') as decimal(38,0))"


def type_(n: str) -> str:
    return f"(case when ends_with({base(n)}, '_rollback') then 1 else 0 end)"


def schema(n: str) -> str:
    b = f"lower({base(n)})"
    return (
        f"(case when ends_with({b}, '_user') and not ends_with({b}, 'pkg_user') and not ends_with({b}, 'pkg_ext_imp_user') then 'USER'"
        f" when ends_with({b}, '_rpt') and not ends_with({b}, 'pkg_rpt') and not ends_with({b}, 'pkg_config_field_rpt') then 'RPT'"
        f" when ends_with({b}, '_pkg') then 'PKG' when ends_with({b}, '_perfstat') then 'PERFSTAT' else 'OWNER' end)"
    )


def commit_name(n: str) -> str:
    return f"(case when {type_(n)} = 1 then replace({n}, '_rollback', '') else {n} end)"


def rollback_name(n: str) -> str:
    return f"(case when {type_(n)} = 1 then {n} else {base(n)} || '_rollback.' || {ext(n)} end)"


def band(n: str) -> str:
    return f"(case when regexp_matches({n}, '^[0-9]{{3,}}_') then 0 else 1 end)"


def fingerprint(t: str) -> str:
    return f"sha1(replace({t}, {CRLF}, chr(10)))"


def normalized(t: str) -> str:
    x = rf"regexp_replace({t}, '--[^\n\r\x{{85}}\x{{2028}}\x{{2029}}]*\r*\n', '', 'g')"
    x = rf"regexp_replace({x}, '/\*[\s\S]*?\*/', '', 'g')"
    x = rf"regexp_replace({x}, '\n+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\s\s+', ' ', 'g')"
    return f"lower(replace({x}, chr(34), ''))"


def phrases(types: tuple[str, ...] | None = None) -> str:
    wanted = types or tuple(T.CHANGE_PHRASES)
    words = [p for t in wanted for p in T.CHANGE_PHRASES[t]]
    return "(" + "|".join(words) + r")\s+(\w+)"


def phrase_type(p: str) -> str:
    whens = " ".join(
        f"when {p} in ({', '.join(repr(w) for w in ws)}) then '{t}'" for t, ws in T.CHANGE_PHRASES.items()
    )
    return f"(case {whens} end)"


def changed(view: str = "dir_scripts", more: str = "") -> str:
    """CTE body: (name, object_name, object_type) found in a view of scripts."""
    n = normalized("text")
    return (
        f"select name, object_name, {phrase_type('phrase')} as object_type from (select name, "
        f"unnest(regexp_extract_all(t, '{phrases()}', 2)) as object_name, "
        f"unnest(regexp_extract_all(t, '{phrases()}', 1)) as phrase "
        f"from (select name, {n} as t from {view} {more}))"
    )


def trim(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"


def strip_schema(d: str) -> str:
    return f"""replace({d}, '"APP".', '')"""


def crlf(d: str) -> str:
    return f"replace({d}, chr(10), {CRLF})"


def canonical_package(d: str) -> str:
    return crlf(rf"regexp_replace({trim(strip_schema(d))}, '\s+/$', chr(10) || '/')")


def canonical_view(d: str) -> str:
    return crlf(rf"regexp_replace({trim(strip_schema(d))}, '\s+;', ';', 'g')")


def canonical_table_unsorted(d: str) -> str:
    x = f"replace({trim(strip_schema(d))}, chr(10) || '  USING INDEX  ENABLE', '')"
    x = rf"regexp_replace({x}, '\s+;', ';', 'g')"
    x = rf"regexp_replace({x}, '\n\s+\(', '(' || chr(10))"
    x = rf"regexp_replace({x}, '\s+\)', chr(10) || ')')"
    x = f"replace({crlf(x)}, chr(9), '    ')"
    return rf"regexp_replace({x}, '\r\n\s+REFERENCES\s', ' REFERENCES ', 'g')"


def letters(n: str) -> str:
    return rf"upper(regexp_replace({n}, '\d', '', 'g'))"


def digits(n: str) -> str:
    return rf"regexp_replace(regexp_replace({n}, '\D', '', 'g'), '^0+', '')"


def sorted_constraints(source: str) -> str:
    """Body over a relation of (object_name, object_type, ddl)."""
    p = r"^([\s\S]*?(?:^|\n))(\s*(?:PRIMARY KEY|CONSTRAINT)[\s\S]*)(\n\s*\)[\s\S]*)\z"
    name = rf"regexp_extract(line, '{T.NAMED_CONSTRAINT_LINE}', 1)"
    rank = rf"case when regexp_matches(line, '{T.PRIMARY_KEY_LINE}') then 0 when {name} <> '' then 1 else 2 end"
    return f"""
    select object_name, object_type, case when block = '' then ddl else
        head || array_to_string(list_transform(list_sort(keyed), lambda k: k.line), ',' || {CRLF}) || tail end as ddl
    from (select *, list_transform(named, lambda s: {{'rank': s.rank, 'letters': {letters('s.key')}, 'digit_count': length({digits('s.key')}),
            'digits': {digits('s.key')}, 'name': s.key, 'position': s.position, 'line': replace(s.line, chr(13), '')}}) as keyed
      from (select *, list_transform(string_split_regex(block, ',\\s*\\n'), lambda line, i: {{'rank': {rank}, 'key': case when {rank} = 1 then {name} else '' end,
            'position': i, 'line': line}}) as named
        from (select *, regexp_extract(ddl, '{p}', 1) as head, regexp_extract(ddl, '{p}', 2) as block, regexp_extract(ddl, '{p}', 3) as tail
          from ({source}))))
    """


def code_style(d: str) -> str:
    x = f"replace(replace({d}, 'NONEDITIONABLE ', ''), 'EDITIONABLE ', '')"
    return unquoted(x)


def unquoted(d: str) -> str:
    pattern = r"(''[^'']*''|--[^\n]*|/\*[\s\S]*?\*/)|" + '"'
    x = rf"regexp_replace({d}, '{pattern}', '\1', 'g')"
    x = rf"""regexp_replace({x}, '\bCASE,', '"CASE",', 'g')"""
    return f"""replace({x}, '(CASE)', '("CASE")')"""


def artifact_path(name: str, kind: str) -> str:
    return (
        f"(case when {kind} in ('PACKAGE', 'PACKAGE_SPEC') then 'packages/' || lower({name}) || '_spec.sql'"
        f" when {kind} in ('PACKAGE BODY', 'PACKAGE_BODY') then 'packages/' || lower({name}) || '.sql'"
        f" when {kind} = 'TABLE' then 'tables/' || lower({name}) || '.sql'"
        f" when {kind} = 'VIEW' then 'views/' || lower({name}) || '.sql'"
        f" when {kind} in ('TYPE', 'TYPE_SPEC') then 'types/' || lower({name}) || '_spec.sql'"
        f" when {kind} in ('TYPE BODY', 'TYPE_BODY') then 'types/' || lower({name}) || '.sql' end)"
    )


def catalogue_type(kind: str) -> str:
    return (
        f"(case {kind} when 'PACKAGE_SPEC' then 'PACKAGE' when 'PACKAGE_BODY' then 'PACKAGE BODY' "
        f"when 'TYPE_SPEC' then 'TYPE' when 'TYPE_BODY' then 'TYPE BODY' else {kind} end)"
    )


def comment(table: str, column: str | None, text: str) -> str:
    target = f"'TABLE \"' || {table} || '\"'" if column is None else f"'COLUMN \"' || {table} || '\".\"' || {column} || '\"'"
    statement = f"'COMMENT ON ' || {target} || ' IS ''' || replace({text}, '''', '''''') || ''';'"
    return statement if column is None else f"replace({statement}, chr(10), '')"


def index_statement(ddl: str) -> str:
    end = "case when compression = 'ENABLED' then ' COMPRESS ' || coalesce(prefix_length, 0) || ';' else ';' end"
    return trim(strip_schema(rf"regexp_replace({ddl}, '\s+;$', {end})"))


def sequence_statement(ddl: str) -> str:
    d = f"{CRLF} || {CRLF} || {trim(strip_schema(ddl))}"
    return rf"""case when contains({ddl}, '"') then regexp_replace({d}, '^([\s\S]*")[\s\S]*$', '\1;') else regexp_replace({d}, '\s+;$', ';') end"""


def trigger_statement(ddl: str) -> str:
    d = rf"regexp_replace({CRLF} || {crlf(trim(strip_schema(ddl)))}, '\s+/', {CRLF} || '/', 'g')"
    return rf"""regexp_replace({d}, 'ALTER TRIGGER "\w+" ENABLE;', '')"""


def package_script(spec: str, body: str) -> str:
    s = rf"regexp_replace(regexp_replace({spec}, '\n+$', ''), ' +$', '')"
    s = f"({s} || case when ends_with({s}, '/') then chr(10) || chr(10) else '/' || chr(10) || chr(10) end)"
    b = rf"regexp_replace(regexp_replace(regexp_replace({body}, ' +$', ''), '\n+$', ''), ' +$', '')"
    full = f"({s} || {b})"
    return f"(case when {body} is null then {s} when ends_with({full}, chr(10)) then {full} else {full} || chr(10) end)"


def year_range(text: str, year: int) -> str:
    return f"regexp_replace({text}, '2003-20[0-9][0-9]', '2003-{year}', 'g')"
