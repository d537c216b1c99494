"""Script names, reconciliation, orders, replay and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.functions import names as N
from ledgerframe.operators import impact as I
from ledgerframe.operators import ordering as O
from ledgerframe.operators import reconcile as R
from ledgerframe.operators import registry as G
from ledgerframe.plans import runs as P
from ledgerframe.session import fresh_path
from ledgerframe.sources import bucketed as B
from ledgerframe.suite import sqltext as S
from ledgerframe.suite.registry import query

FACTS = f"{S.order_number('name')} as order_number, {S.band('name')} as band, {S.type_('name')} as type, {S.schema('name')} as schema_type"


def scalar(name: str, rule, sql: str, reads: str = "name") -> None:
    """Register a column rule over all scripts of the directory."""

    @query(name, f"select name, {sql} as {name} from dir_scripts")
    def _(v):
        return v("dir_scripts").select("name", rule(F.col(reads)).alias(name))


scalar("order_number", N.order_number, S.order_number("name"))
scalar("script_type", N.script_type, S.type_("name"))
scalar("schema_type", N.schema_type, S.schema("name"))
scalar("effective_schema", N.effective_schema, S.schema(S.commit_name("name")))
scalar("rollback_name", N.rollback_name, S.rollback_name("name"))
scalar("commit_name", N.commit_name, S.commit_name("name"))
scalar("fingerprint", N.fingerprint, S.fingerprint("text"), reads="text")
scalar("execution_band", N.execution_band, S.band("name"))


@query(
    "status_of_exit_code",
    "select run_id, step_id, case when exit_code = 0 then 0 else 2 end as status from run_log",
)
def _(v):
    return v("run_log").select("run_id", "step_id", N.status_of_exit_code(F.col("exit_code")).alias("status"))


@query(
    "duration_hms",
    "select run_id, step_id, ms as elapsed_ms, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as elapsed"
    " from (select run_id, step_id, cast(floor(seconds * 1000) as bigint) as ms from run_log)",
)
def _(v):
    ms = N.elapsed_ms(F.col("seconds"))
    return v("run_log").select("run_id", "step_id", ms.alias("elapsed_ms"), N.duration_hms(ms).alias("elapsed"))


@query("ignored_scripts", f"select name from dir_scripts where not {S.valid('name')}")
def _(v):
    return R.ignored_scripts(v("dir_scripts")).select("name")


@query("valid_scripts", f"select name from dir_scripts where {S.valid('name')}")
def _(v):
    return R.valid_scripts(v("dir_scripts")).select("name")


@query("development_scripts", f"select name, text from dir_scripts where {S.order_number('name')} < 100")
def _(v):
    return R.development_scripts(v("dir_scripts"))


PACKAGE_HIT = f"coalesce(regexp_matches({S.normalized('text')}, '{S.phrases(('PACKAGE_BODY', 'PACKAGE_SPEC'))}'), false)"


def profile_check(tail: str) -> str:
    return f"""select name, s as schema_type, {S.schema(S.commit_name('name'))} as effective_schema,
    case when s = 'OWNER' then 'compile_invalids_{tail}' else 'plain_{tail}' end as wrapper,
    case when s = 'OWNER' and not p then 1 else 0 end as enable_locked
    from (select name, {S.schema('name')} as s, {PACKAGE_HIT} as p from dir_scripts)"""


@query("execution_profile", profile_check("fail_on_error"))
def _(v):
    return O.execution_profile(v("dir_scripts"))


@query("execution_profile_ignore_errors", profile_check("not_fail_on_error"))
def _(v):
    return O.execution_profile(v("dir_scripts"), ignore_errors=True)


# --- registry -----------------------------------------------------------------


@query(
    "read_registry",
    "select name, script_id, text, type, status from registry_log qualify row_number() over (partition by name order by script_id desc) = 1",
)
def _(v):
    return G.read_registry(v("registry_log"))


@query(
    "registry_duplicates",
    f"select name, {S.fingerprint('text')} as file_hash, count(*) as n_rows from registry_log group by all having count(*) > 1",
)
def _(v):
    return G.registry_duplicates(G.with_fingerprint(v("registry_log")))


@query("registry_count", "select count(*) as n_rows, count(*) = 0 as first_run from registry")
def _(v):
    return G.registry_count(v("registry"))


@query(
    "bootstrap_registry",
    f"select name, {S.fingerprint('text')} as file_hash, text, {S.type_('name')} as type, 0 as status from dir_scripts where {S.valid('name')}",
)
def _(v):
    return G.bootstrap_registry(v("dir_scripts"))


# Shared relations of the reconciliation checks.
SIDES = f"""with d as (select name, text, {S.fingerprint('text')} as dir_hash from dir_scripts where {S.valid('name')}),
r as (select name, script_id, text, status, {S.fingerprint('text')} as reg_hash from registry),
del as (select name, {FACTS} from r where name not in (select name from d)),
pairs as (select name, {S.commit_name('name')} as commit_name, {FACTS} from del where type = 1 and {S.commit_name('name')} in (select name from del)),
fresh as (select name, text, dir_hash, {FACTS} from d where name not in (select name from r)),
upd as (select d.name, d.text, r.script_id, d.dir_hash as file_hash from d join r using (name) where d.dir_hash <> r.reg_hash)
"""


@query(
    "apply_changes",
    SIDES
    + f"""select name, coalesce(upd.file_hash, reg_hash) as file_hash, coalesce(upd.text, r.text) as text, {S.type_('name')} as type, status
    from r left join upd using (name) where name not in (select name from del)
    union all select name, dir_hash as file_hash, text, type, 0 as status from fresh""",
)
def _(v):
    directory, registry = v("dir_scripts"), v("registry")
    inserts = G.bootstrap_registry(R.new_scripts(directory, registry))
    current = G.with_fingerprint(registry).select("name", "file_hash", "text", "type", "status")
    return G.apply_changes(
        current, inserts, R.updated_scripts(directory, registry), R.deleted_names(directory, registry)
    )


@query(
    "bucketed_registry",
    SIDES
    + f"""select name, coalesce(upd.file_hash, reg_hash) as file_hash, coalesce(upd.text, r.text) as text, {S.type_('name')} as type, status
    from r left join upd using (name) where name not in (select name from del)
    union all select name, dir_hash as file_hash, text, type, 0 as status from fresh""",
)
def _(v):
    directory, registry = v("dir_scripts"), v("registry")
    root = fresh_path(v.spark, "bucketed")
    B.create(G.with_fingerprint(registry).select("name", "file_hash", "text", "type", "status"), root)
    inserts = G.bootstrap_registry(R.new_scripts(directory, registry))
    updates, deletes = R.updated_scripts(directory, registry), R.deleted_names(directory, registry)
    B.commit(v.spark, root, inserts=inserts)
    B.commit(v.spark, root, updates=updates.select("name", "file_hash", "text"), deletes=deletes)
    return B.read(v.spark, root).drop("bucket")


@query("semi_filter", SIDES + "select script_id, name, text, type, status from registry where name in (select name from d)")
def _(v):
    return G.semi_filter(v("registry"), R.valid_scripts(v("dir_scripts")), ["name"])


@query("semi_filter_delete", SIDES + "select script_id, name, text, type, status from registry where name not in (select name from d)")
def _(v):
    return G.semi_filter(v("registry"), R.valid_scripts(v("dir_scripts")), ["name"], keep=False)


# --- reconciliation -------------------------------------------------------------


@query("new_scripts", SIDES + "select name, text from fresh")
def _(v):
    return R.new_scripts(v("dir_scripts"), v("registry"))


@query("deleted_scripts", SIDES + "select name, script_id, text, type, status from registry where name in (select name from del)")
def _(v):
    return R.deleted_scripts(v("dir_scripts"), v("registry"))


@query("updated_scripts", SIDES + "select name, text, script_id, file_hash from upd")
def _(v):
    return R.updated_scripts(v("dir_scripts"), v("registry"))


@query(
    "unchanged_scripts",
    SIDES + "select name, script_id, dir_hash as file_hash from d join r using (name) where dir_hash = reg_hash",
)
def _(v):
    return R.unchanged_scripts(v("dir_scripts"), v("registry"))


@query(
    "orphaned_rollbacks",
    SIDES
    + f"select name, {S.rollback_name('name')} as rollback_name from del where type = 0 and {S.rollback_name('name')} in (select name from d)",
)
def _(v):
    return R.orphaned_rollbacks(v("dir_scripts"), v("registry"))


@query("paired_rollbacks", SIDES + "select name, commit_name from pairs")
def _(v):
    return R.paired_rollbacks(v("dir_scripts"), v("registry"))


@query(
    "unpaired_deletions",
    SIDES
    + "select name, type from del where name not in (select name from pairs) and name not in (select commit_name from pairs)",
)
def _(v):
    return R.unpaired_deletions(v("dir_scripts"), v("registry"))


RECONCILED = """select name, case when reg_hash is null then 'new' when dir_hash is null then 'deleted'
    when dir_hash <> reg_hash then 'updated' else 'unchanged' end as change, dir_hash, reg_hash from d full join r using (name)"""


@query("reconcile", SIDES + RECONCILED)
def _(v):
    return R.reconcile(v("dir_scripts"), v("registry"))


@query(
    "change_summary",
    SIDES
    + f"select change, {S.type_('name')} as type, {S.schema('name')} as schema_type, count(*) as n_scripts from ({RECONCILED}) group by all",
)
def _(v):
    return R.change_summary(v("dir_scripts"), v("registry"))


# --- orders and replay ------------------------------------------------------------


def order_query(name: str, operator, where: str) -> None:
    @query(name, f"select * from (select name, {FACTS} from dir_scripts) where {where}")
    def _(v):
        return operator(v("dir_scripts").select("name"))


order_query("natural_order", O.natural_order, "true")
order_query("commit_order", O.commit_order, "type = 0")
order_query("rollback_order", O.rollback_order, "type = 1")


def position_query(name: str, operator, where: str, order: str) -> None:
    @query(
        name,
        f"""select *, row_number() over (order by {order}) as position
        from (select name, {FACTS} from dir_scripts) where {where} and order_number is not null""",
    )
    def _(v):
        return operator(v("dir_scripts").select("name"))


position_query("commit_positions", O.commit_positions, "type = 0", "band, order_number, name")
position_query("rollback_positions", O.rollback_positions, "type = 1", "band desc, order_number desc, name desc")

MARKED = """with marked as (select *, coalesce(sum(case when exit_code <> 0 then 1 else 0 end)
    over (partition by run_id order by ts, step_id rows between unbounded preceding and 1 preceding), 0) = 0 as recorded from run_log)
"""


@query(
    "run_until_failure",
    MARKED
    + "select run_id, step_id, ts, exit_code, seconds, case when exit_code = 0 then 0 else 2 end as status from marked where recorded",
)
def _(v):
    return O.run_until_failure(v("run_log"))


@query(
    "run_until_failure_ignore_errors",
    "select run_id, step_id, ts, exit_code, seconds, case when exit_code = 0 then 0 else 2 end as status from run_log",
)
def _(v):
    return O.run_until_failure(v("run_log"), ignore_errors=True)


@query(
    "run_summary",
    MARKED
    + """select run_id, steps_recorded, steps_remaining, first_failed_step, ms as elapsed_ms,
    printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as elapsed
    from (select run_id, count(*) filter (recorded) as steps_recorded, count(*) filter (not recorded) as steps_remaining,
      min(step_id) filter (recorded and exit_code <> 0) as first_failed_step,
      cast(sum(cast(floor(seconds * 1000) as bigint)) filter (recorded) as bigint) as ms from marked group by run_id)""",
)
def _(v):
    return O.run_summary(v("run_log"))


@query(
    "failed_runs",
    MARKED + "select run_id, step_id as first_failed_step, ts as failed_at from marked where recorded and exit_code <> 0",
)
def _(v):
    return O.failed_runs(v("run_log"))


def forward_check(action: str) -> str:
    return (
        SIDES
        + f"""select case when type = 1 then 0 else 1 end as phase, band, order_number, name, schema_type,
    case when type = 1 then 'register' else {action} end as action from fresh"""
    )


@query("forward_plan", forward_check("case when schema_type = 'PERFSTAT' then 'unsupported' else 'execute' end"))
def _(v):
    return P.forward_plan(v("dir_scripts"), v("registry"), execute=True)


@query(
    "forward_plan_positions",
    f"""select *, row_number() over (order by phase, band, order_number nulls first, name) as position
    from ({forward_check("case when schema_type = 'PERFSTAT' then 'unsupported' else 'execute' end")})""",
)
def _(v):
    return P.positioned(P.forward_plan(v("dir_scripts"), v("registry"), execute=True))


# Every script whose name has a multiple of three characters gets a number of 39 digits.
BEYOND = "9" * 39
FAR_SQL = f"(select case when length(name) % 3 = 0 then '{BEYOND}_' || name else name end as name, text from dir_scripts)"


def far_scripts(v):
    name = F.col("name")
    far = F.when(F.length(name) % 3 == 0, F.concat(F.lit(f"{BEYOND}_"), name)).otherwise(name)
    return v("dir_scripts").select(far.alias("name"), "text")


@query(
    "quarantined_scripts",
    f"select name, text, 'order number out of range' as reason from {FAR_SQL} where {S.valid('name')} and name like '{BEYOND}%'",
)
def _(v):
    return R.quarantined_scripts(far_scripts(v))


@query(
    "forward_plan_quarantine",
    f"""select name, case when name like '{BEYOND}%' then 'quarantined' when {S.type_('name')} = 1 then 'register' else 'copy' end as action
    from {FAR_SQL} where {S.valid('name')} and name not in (select name from registry)""",
)
def _(v):
    return P.forward_plan(far_scripts(v), v("registry"), execute=False).select("name", "action")


@query("forward_plan_copy", forward_check("'copy'"))
def _(v):
    return P.forward_plan(v("dir_scripts"), v("registry"), execute=False)


def plan_check(action: str) -> str:
    return (
        SIDES
        + f"""select name, type, band, order_number,
    case when name in (select name from pairs) then '{action}' else 'none' end as action, 'delete' as effect from del"""
    )


@query("rollback_plan_skip", plan_check("list"))
def _(v):
    return P.rollback_plan(v("dir_scripts"), v("registry"), P.SKIP, execute=True)


@query("rollback_plan_copy", plan_check("copy"))
def _(v):
    return P.rollback_plan(v("dir_scripts"), v("registry"), P.ASK, execute=True, confirm=False)


# Forced rollbacks: one per forward name, in descending order up to the first failure.
FORCED = """, codes as (select name, max(exit_code) as exit_code from outcomes group by name),
steps as (select p.*, coalesce(c.exit_code, 0) as code from pairs p left join codes c using (name)
    qualify row_number() over (partition by commit_name order by band desc, order_number desc nulls last, name desc) = 1),
ran as (select *, coalesce(sum(code) over (order by band desc, order_number desc nulls last, name desc
    rows between unbounded preceding and 1 preceding), 0) = 0 as reached from steps),
plan as (select name, type, band, order_number,
    coalesce((select case when reached then 'run' else 'not_reached' end from ran where ran.name = del.name),
      (select case when reached then 'undone' else 'not_reached' end from ran where ran.commit_name = del.name), 'none') as action from del)
"""


@query(
    "rollback_plan",
    SIDES
    + FORCED
    + """select name, type, band, order_number, action,
    case when action in ('run', 'undone') or (select count(*) from pairs) = 0 then 'delete' else 'keep' end as effect from plan""",
)
def _(v):
    return P.rollback_plan(
        v("dir_scripts"), v("registry"), P.FORCE_EXECUTE, execute=True, outcomes=v("outcomes")
    )


UPDATED_ROWS = f"""select name, coalesce(upd.file_hash, reg_hash) as file_hash, coalesce(upd.text, r.text) as text, {S.type_('name')} as type, status
    from r left join upd using (name)"""


@query(
    "next_registry",
    SIDES
    + FORCED
    + f""", kept as ({UPDATED_ROWS} where name not in (select name from plan where action in ('run', 'undone'))
      and not ((select count(*) from pairs) = 0 and name in (select name from del))),
    go as (select fresh.*, coalesce(c.exit_code, 0) as code from fresh left join codes c using (name)),
    seen as (select *, sum(case when type = 0 then code else 0 end) over w as failed_before,
      sum(case when type = 0 and schema_type = 'PERFSTAT' then 1 else 0 end) over w
        + case when type = 0 and schema_type = 'PERFSTAT' then 1 else 0 end as stuck from go
      window w as (order by type desc, band, order_number nulls first, name rows between unbounded preceding and 1 preceding))
    select name, file_hash, text, type, status from kept
    union all
    select name, dir_hash as file_hash, text, type, case when type = 0 and code <> 0 then 2 else 0 end as status from seen
    where (type = 1 or (coalesce(failed_before, 0) = 0 and coalesce(stuck, 0) = 0)) and (select coalesce(sum(code), 0) from ran where reached) = 0""",
)
def _(v):
    return P.next_registry(
        v("dir_scripts"), v("registry"), P.FORCE_EXECUTE, execute=True, outcomes=v("outcomes")
    )


@query(
    "next_registry_ignore_errors",
    SIDES
    + f""", codes as (select name, max(exit_code) as exit_code from outcomes group by name)
    {UPDATED_ROWS} where name not in (select name from del)
    union all
    select name, dir_hash as file_hash, text, type, case when type = 0 and coalesce(exit_code, 0) <> 0 then 2 else 0 end as status
    from fresh left join codes using (name)""",
)
def _(v):
    return P.next_registry(
        v("dir_scripts"),
        v("registry"),
        P.SKIP,
        execute=True,
        outcomes=v("outcomes"),
        ignore_errors=True,
        unsupported=(),
    )


@query(
    "next_registry_copy",
    SIDES
    + f"""{UPDATED_ROWS} where name not in (select name from del)
    union all
    select name, dir_hash as file_hash, text, type, 0 as status from fresh where (select count(*) from pairs) = 0""",
)
def _(v):
    return P.next_registry(v("dir_scripts"), v("registry"), P.ASK, execute=False)


# --- impact -------------------------------------------------------------------------


@query("normalize_script", f"select name, {S.normalized('text')} as text from dir_scripts")
def _(v):
    return I.normalize_scripts(v("dir_scripts"))


@query("changed_objects", S.changed())
def _(v):
    return I.changed_objects(v("dir_scripts"))


@query("distinct_changed_objects", f"select distinct object_name, object_type from ({S.changed()})")
def _(v):
    return I.distinct_changed_objects(v("dir_scripts"))


@query(
    "object_touch_counts",
    f"select object_name, object_type, count(distinct name) as n_scripts from ({S.changed()}) group by all",
)
def _(v):
    return I.object_touch_counts(v("dir_scripts"))


@query("is_package_script", f"select name, {PACKAGE_HIT} as is_package_script from dir_scripts")
def _(v):
    return I.package_scripts(v("dir_scripts"))


@query(
    "ddl_candidates",
    SIDES
    + f"""select name, text, {S.order_number('name')} as order_number from d where {S.type_('name')} = 0 and {S.schema('name')} = 'OWNER'
    and ({S.order_number('name')} < 100 or name in (select name from upd))""",
)
def _(v):
    return I.ddl_candidates(v("dir_scripts"), v("registry"))
