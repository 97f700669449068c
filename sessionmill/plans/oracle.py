"""Expected results of the registered queries as DuckDB SQL over the driver tables.

``FX`` states, per event, the effect the derived transcript line must have;
no JSON is read on this side.
"""

FX = r"""
base AS (
  SELECT event_id, user_id, event_type, ts, value,
    's' || user_id AS file, user_id % 3 = 0 AS b,
    CASE WHEN user_id % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS source,
    event_id % 97 = 0 AS bad,
    user_id % 3 <> 0 AND event_id % 29 = 0 AND event_id % 97 <> 0 AS side,
    CASE WHEN event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 97 = 0 THEN NULL ELSE ts END AS t,
    CASE user_id % 4 WHEN 0 THEN '/mnt/c/Work/p' || (user_id % 10) WHEN 1 THEN 'C:\Work\p' || (user_id % 10)
         WHEN 2 THEN '/home/dev/p' || (user_id % 10) ELSE '' END AS dir,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'b' || (event_id % 3) END AS branch,
    'c' || (event_id % 7) AS call,
    CASE user_id % 6 WHEN 0 THEN 'claude-fable-x' WHEN 1 THEN 'claude-3-opus' WHEN 2 THEN 'claude-opus-4'
         WHEN 3 THEN 'claude-sonnet-4' WHEN 4 THEN 'Claude-Haiku-4' ELSE 'gpt-x' END AS model_name,
    CASE WHEN event_id % 2 = 0 THEN user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) ELSE 'x' || (event_id // 4) END AS msg
  FROM events
),
who AS (
  SELECT *, NOT b AND NOT bad AND NOT side AND event_type IN ('click', 'purchase') AS says,
    NOT b AND NOT bad AND NOT side AND (event_type IN ('signup', 'view') OR (event_type = 'error' AND event_id % 3 = 0)) AS asks,
    event_type = 'signup' AND event_id % 11 = 0 AS meta, b AND NOT bad AS env
  FROM base
),
fx0 AS (
  SELECT *,
    CASE WHEN says OR asks OR env THEN t END AS active_ts,
    CASE WHEN says THEN false
         WHEN asks AND event_type = 'view' AND event_id % 13 = 0 THEN true
         WHEN asks AND event_type = 'signup' AND NOT meta THEN false
         WHEN asks AND event_type = 'error' THEN true
         WHEN env AND event_type = 'signup' THEN false
         WHEN env AND event_type = 'error' AND (event_id % 4 = 2 OR event_id % 8 = 3) THEN true END AS interrupted,
    CASE WHEN says AND event_type = 'click' THEN false
         WHEN says AND event_id % 6 = 0 THEN false
         WHEN says AND event_id % 6 = 1 THEN NULL
         WHEN says THEN true
         WHEN asks AND event_type <> 'view' AND NOT meta THEN false
         WHEN env AND event_type = 'signup' THEN false
         WHEN env AND event_type = 'purchase' AND event_id % 3 = 0 THEN true END AS finished,
    CASE WHEN says AND event_type = 'click' THEN 'tool_use'
         WHEN says AND event_id % 6 = 0 THEN 'max_tokens'
         WHEN says AND event_id % 6 = 1 THEN NULL
         WHEN says THEN 'end_turn'
         WHEN asks AND event_type <> 'view' AND NOT meta THEN '' END AS stop,
    (asks AND event_type = 'error') OR (env AND ((event_type = 'signup' AND event_id % 2 = 0)
      OR (event_type = 'purchase' AND event_id % 3 = 0) OR (event_type = 'error' AND (event_id % 4 = 2 OR event_id % 8 = 3)))) AS clears,
    CASE WHEN ((says OR env) AND event_type = 'click') OR ((asks OR env) AND event_type = 'view') THEN call END AS call_id,
    CASE WHEN (says OR env) AND event_type = 'click' THEN true WHEN (asks OR env) AND event_type = 'view' THEN false END AS opens,
    CASE WHEN NOT (says OR env) OR event_type <> 'click' THEN NULL WHEN event_id % 23 = 0 THEN 'tool'
         WHEN says AND event_id % 5 = 0 THEN 'TodoWrite' WHEN says THEN 'Tool' || (event_id % 4) ELSE 'shell' || (event_id % 4) END AS call_name,
    CASE WHEN says AND event_type = 'click' AND event_id % 2 = 0 THEN 'step ' || event_id END AS call_label,
    says AND event_type = 'click' AND event_id % 5 = 0 AND event_id % 23 <> 0 AS todos_set,
    CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'doing ' ELSE 'do ' END || event_id END AS todo_text,
    CASE WHEN says THEN CASE WHEN event_id % 31 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END END AS tin,
    CASE WHEN says THEN CASE WHEN event_id % 37 = 0 THEN 0 ELSE event_id % 500 END END AS tout,
    CASE WHEN says THEN CASE WHEN event_id % 47 = 0 THEN 0 ELSE event_id % 9000 END END AS tread,
    CASE WHEN says THEN event_id % 70 END AS twrite,
    env AND event_type = 'purchase' AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS counted,
    env AND event_type = 'purchase' AND event_id % 3 <> 0 AND event_id % 2 = 0 AS limited
  FROM who
),
fx AS (
  SELECT *, coalesce(t, max(active_ts) OVER (PARTITION BY file ORDER BY event_id), TIMESTAMP '1970-01-01') AS since,
    (active_ts IS NOT NULL OR interrupted IS NOT NULL OR finished IS NOT NULL OR clears OR call_id IS NOT NULL OR todos_set) AS useful,
    CASE WHEN call_label IS NULL THEN call_name ELSE call_name || ': ' || call_label END AS task
  FROM fx0
),
nowt AS (SELECT max(ts) AS now FROM events)
"""

MSG = """
msgs AS (
  SELECT file, source, user_id, msg AS message_id, arg_max({'ts': t, 'i': tin, 'o': tout, 'r': tread, 'w': twrite}, event_id) AS m
  FROM fx WHERE says GROUP BY file, source, user_id, msg
),
message AS (SELECT file, source, user_id, message_id, m.ts AS ts, m.i AS tin, m.o AS tout, m.r AS tread, m.w AS twrite FROM msgs),
owned AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, file DESC) AS rn FROM message WHERE ts IS NOT NULL) WHERE rn = 1
),
totals AS (
  SELECT file, source, user_id, event_id, t AS ts, event_id * 7 % 100000 AS ci, event_id * 3 % 50000 AS cc, event_id * 2 % 30000 AS co
  FROM fx WHERE counted AND t IS NOT NULL
),
lagged AS (
  SELECT *, lag(ci, 1, 0) OVER w AS pi, lag(cc, 1, 0) OVER w AS pc, lag(co, 1, 0) OVER w AS po
  FROM totals WINDOW w AS (PARTITION BY file ORDER BY event_id)
),
steps AS (
  SELECT *, CASE WHEN ci < pi OR co < po THEN ci ELSE ci - pi END AS di,
    CASE WHEN ci < pi OR co < po THEN cc ELSE greatest(cc - pc, 0) END AS dc,
    CASE WHEN ci < pi OR co < po THEN co ELSE co - po END AS d_o FROM lagged
),
deltas AS (
  SELECT file, source, user_id, event_id, ts, greatest(di - dc, 0) AS tin, d_o AS tout, dc AS tread, 0 AS twrite
  FROM steps WHERE di > 0 OR d_o > 0
),
uev AS (
  SELECT file, source, user_id, message_id, ts, tin, tout, tread, twrite FROM owned
  UNION ALL SELECT file, source, user_id, NULL, ts, tin, tout, tread, twrite FROM deltas
)
"""

HOURS = """
hourly AS (
  SELECT user_id % 5 AS account, date_trunc('hour', ts) AS h, sum(tin) AS tin, sum(tout) AS tout, sum(tread) AS tread, sum(twrite) AS twrite, count(*) AS n
  FROM owned WHERE ts <= (SELECT now FROM nowt) GROUP BY 1, 2
),
hop AS (
  SELECT a.account, a.h, min(b.h) AS nxt FROM hourly a LEFT JOIN hourly b ON a.account = b.account AND b.h >= a.h + INTERVAL 5 HOUR GROUP BY 1, 2
),
starts AS (
  SELECT account, min(h) AS h FROM hourly GROUP BY 1
  UNION ALL SELECT s.account, hop.nxt FROM starts s JOIN hop ON hop.account = s.account AND hop.h = s.h WHERE hop.nxt IS NOT NULL
),
blk AS (
  SELECT s.account, s.h AS start, sum(tin) AS tin, sum(tout) AS tout, sum(tread) AS tread, sum(twrite) AS twrite, sum(n) AS n
  FROM starts s JOIN hourly x ON x.account = s.account AND x.h >= s.h AND x.h < s.h + INTERVAL 5 HOUR GROUP BY 1, 2
)
"""

STATE = """
ep AS (SELECT *, sum(CASE WHEN clears THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY event_id) AS epoch FROM fx),
dl AS (
  SELECT *, CASE WHEN call_id IS NULL THEN 0 ELSE CAST(opens AS INT) - coalesce(lag(CAST(opens AS INT)) OVER c, 0) END AS d,
    CASE WHEN call_id IS NOT NULL THEN lead(event_id) OVER c END AS ends
  FROM ep WINDOW c AS (PARTITION BY file, epoch, call_id ORDER BY event_id)
),
ln AS (
  SELECT *, sum(d) OVER (PARTITION BY file, epoch ORDER BY event_id) AS pending,
    max(active_ts) OVER w AS last_activity,
    coalesce(last_value(interrupted IGNORE NULLS) OVER w, false) AS intr,
    coalesce(last_value(finished IGNORE NULLS) OVER w, false) AS fin,
    last_value(CASE WHEN todos_set THEN {'x': todo_text} END IGNORE NULLS) OVER w AS todo,
    max(event_id) OVER (PARTITION BY file, epoch) AS epoch_end
  FROM dl WINDOW w AS (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING)
),
st AS (
  SELECT *, CASE WHEN last_activity IS NULL THEN NULL WHEN intr THEN 'interrupted' WHEN pending > 0 THEN 'tool_running'
    WHEN fin THEN 'done' ELSE 'thinking' END AS state FROM ln
)
"""

# final facts per file
FACTS = """
calls AS (
  SELECT file, call_id, max(CASE WHEN opens THEN event_id END) AS o, max(CASE WHEN NOT opens THEN event_id END) AS c,
    arg_max({'task': task, 'since': since}, event_id) FILTER (WHERE opens) AS call
  FROM fx WHERE call_id IS NOT NULL GROUP BY 1, 2
),
f0 AS (
  SELECT file, source, user_id,
    max(active_ts) AS last_activity, min(active_ts) AS first_activity,
    coalesce(arg_max(interrupted, event_id) FILTER (WHERE interrupted IS NOT NULL), false) AS intr,
    coalesce(arg_max(finished, event_id) FILTER (WHERE finished IS NOT NULL), false) AS fin,
    arg_max(stop, event_id) FILTER (WHERE stop IS NOT NULL) AS stop,
    max(event_id) FILTER (WHERE clears) AS cleared,
    arg_max({'x': todo_text}, event_id) FILTER (WHERE todos_set) AS todo,
    count(*) FILTER (WHERE todos_set) AS todo_writes,
    count(*) AS lines, count(*) FILTER (WHERE bad) AS parse_errors, count(*) FILTER (WHERE side) AS sidechain_records,
    CASE WHEN user_id % 3 = 0 THEN arg_max(file, event_id) FILTER (WHERE env AND event_type = 'error' AND event_id % 4 = 0)
         ELSE arg_max(file, event_id) FILTER (WHERE NOT bad) END AS session_id,
    CASE WHEN user_id % 3 = 0 THEN arg_max(dir, event_id) FILTER (WHERE env AND event_type = 'error' AND event_id % 4 <= 1)
         ELSE arg_max(dir, event_id) FILTER (WHERE NOT bad AND dir <> '') END AS cwd,
    CASE WHEN user_id % 3 = 0 THEN arg_max(branch, event_id) FILTER (WHERE env AND event_type = 'error' AND event_id % 4 = 0)
         ELSE arg_max(branch, event_id) FILTER (WHERE NOT bad AND branch <> '') END AS git_branch,
    CASE WHEN user_id % 3 = 0 THEN arg_max(model_name, event_id) FILTER (WHERE env AND event_type = 'error' AND event_id % 4 = 1)
         ELSE arg_max(model_name, event_id) FILTER (WHERE says) END AS model,
    arg_max('p' || (event_id % 3), event_id) FILTER (WHERE env AND event_type = 'error' AND event_id % 4 = 1) AS approval_policy,
    arg_max({'i': tin, 'r': tread, 'w': twrite}, event_id) FILTER (WHERE says) AS lastu,
    arg_max({'i': event_id * 7 % 100000, 'c': event_id * 3 % 50000, 'o': event_id * 2 % 30000, 'l': event_id % 300000}, event_id) FILTER (WHERE counted) AS total,
    arg_max(CASE WHEN counted THEN 190000 + event_id % 3 ELSE 200000 + event_id % 7 END, event_id)
      FILTER (WHERE counted OR (env AND event_type = 'signup' AND event_id % 2 = 0)) AS win
  FROM fx GROUP BY file, source, user_id
),
pend AS (
  SELECT c.file, count(*) AS n, arg_max(c.call.task, {'s': c.call.since, 'o': c.o}) AS task
  FROM calls c JOIN f0 ON f0.file = c.file
  WHERE c.o IS NOT NULL AND (c.c IS NULL OR c.o > c.c) AND (f0.cleared IS NULL OR c.o > f0.cleared) GROUP BY 1
),
facts AS (
  SELECT f0.*, coalesce(pend.n, 0) AS pending, CASE WHEN pend.n > 0 THEN pend.task ELSE f0.todo.x END AS current_task
  FROM f0 LEFT JOIN pend ON pend.file = f0.file
),
hooks AS (
  SELECT file, arg_max(event_type, event_id) AS kind, arg_max(event_id, event_id) AS hid, arg_max(ts, event_id) + INTERVAL 1 MINUTE AS at
  FROM base WHERE event_type IN ('error', 'click') GROUP BY 1
),
waiting AS (
  SELECT f.file, f.session_id, 'Needs your PERMISSION to use ' || (h.hid % 4) AS prompt, h.at AS prompt_ts
  FROM facts f JOIN hooks h ON h.file = f.session_id
  WHERE f.source = 'claude-code' AND h.kind = 'error' AND (f.last_activity IS NULL OR f.last_activity <= h.at)
    AND (f.first_activity IS NULL OR f.first_activity - h.at < INTERVAL 300 SECOND)
),
stated AS (
  SELECT f.*, w.prompt,
    CASE WHEN f.last_activity IS NULL THEN 'idle' WHEN f.intr THEN 'interrupted' WHEN w.prompt IS NOT NULL THEN 'needs_you'
      WHEN f.pending > 0 THEN 'tool_running' WHEN f.fin THEN 'done'
      WHEN now - f.last_activity >= INTERVAL 30 MINUTE THEN 'stale' WHEN now - f.last_activity >= INTERVAL 10 SECOND THEN 'idle' ELSE 'thinking' END AS state
  FROM facts f LEFT JOIN waiting w ON w.file = f.file, nowt
),
used AS (
  SELECT f.file, f.source,
    CAST(CASE WHEN f.source = 'codex' THEN coalesce(greatest(f.total.i - f.total.c, 0), 0) ELSE coalesce(m.tin, 0) END AS BIGINT) AS tin,
    CAST(CASE WHEN f.source = 'codex' THEN coalesce(f.total.o, 0) ELSE coalesce(m.tout, 0) END AS BIGINT) AS tout,
    CAST(CASE WHEN f.source = 'codex' THEN coalesce(f.total.c, 0) ELSE coalesce(m.tread, 0) END AS BIGINT) AS tread,
    CAST(CASE WHEN f.source = 'codex' THEN 0 ELSE coalesce(m.twrite, 0) END AS BIGINT) AS twrite,
    CASE WHEN f.source = 'codex' THEN CASE WHEN f.total IS NOT NULL AND f.win > 0 THEN least(CAST(CAST(f.total.l AS FLOAT) / CAST(f.win AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT), CAST(100 AS FLOAT)) END
      WHEN f.lastu.i + f.lastu.r + f.lastu.w > 0 THEN least(CAST(CAST(f.lastu.i + f.lastu.r + f.lastu.w AS FLOAT) / CAST(200000 AS FLOAT) AS FLOAT) * CAST(100 AS FLOAT), CAST(100 AS FLOAT)) END AS pct
  FROM facts f LEFT JOIN (SELECT file, sum(tin) AS tin, sum(tout) AS tout, sum(tread) AS tread, sum(twrite) AS twrite FROM message GROUP BY 1) m ON m.file = f.file
)
"""

OBS = r"""
obs AS (
  SELECT 's' || user_id AS agent_id, CASE WHEN user_id % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS source,
    CASE WHEN event_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine,
    CASE user_id % 4 WHEN 0 THEN '/mnt/c/Work/p' || (user_id % 10) WHEN 1 THEN 'C:\Work\p' || (user_id % 10) || '\'
      WHEN 2 THEN '\\wsl$\Ubuntu\home\dev\p' || (user_id % 10) ELSE '/home/Dev/p' || (user_id % 10) || '//' END AS project,
    CASE user_id % 4 WHEN 0 THEN 'c:/work/p' || (user_id % 10) WHEN 1 THEN 'c:/work/p' || (user_id % 10) ELSE '/home/dev/p' || (user_id % 10) END AS norm,
    CASE event_type WHEN 'signup' THEN 'thinking' WHEN 'click' THEN 'tool_running' WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'done' ELSE 'needs_you' END AS status,
    CASE WHEN user_id % 5 <> 0 THEN 'b' || (user_id % 3) END AS git_branch,
    CASE WHEN event_type = 'click' THEN 'shell' END AS current_task,
    event_type = 'error' AS needs_user,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'interrupted by user' END AS needs_user_reason,
    CASE WHEN event_id % 113 = 0 THEN 'garbage' ELSE strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S.000Z') END AS last_activity,
    CASE WHEN event_id % 113 = 0 THEN NULL ELSE date_trunc('day', ts) END AS act,
    user_id, event_id AS arrival, ts
  FROM events
),
nowt AS (SELECT max(ts) AS now FROM events),
chg0 AS (
  SELECT *, machine || '/' || source || '/' || agent_id AS key, source || '/' || agent_id AS logical_key,
    lag({'s': status, 'n': needs_user, 't': current_task, 'r': needs_user_reason, 'l': last_activity}) OVER w AS was,
    row_number() OVER w AS rn
  FROM obs WINDOW w AS (PARTITION BY machine, source, agent_id ORDER BY arrival)
),
chg AS (
  SELECT *, CASE WHEN rn = 1 THEN 'new'
      WHEN was = {'s': status, 'n': needs_user, 't': current_task, 'r': needs_user_reason, 'l': last_activity} THEN 'unchanged' ELSE 'updated' END AS change_type,
    rn = 1 OR was.s <> status AS status_changed,
    needs_user AND NOT coalesce(was.n, false) AS entered_needs_you, was.s AS from_status
  FROM chg0
),
cur AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY machine, source, agent_id ORDER BY arrival DESC) AS r FROM obs) WHERE r = 1),
aged AS (
  SELECT *, act IS NULL OR now - act >= INTERVAL 30 MINUTE AS silent30, act IS NULL OR now - act >= INTERVAL 24 HOUR AS silent24,
    status NOT IN ('stale', 'done', 'needs_you', 'failed') AS decays, now
  FROM cur, nowt
)
"""

LOGICAL = """
r1 AS (
  SELECT *, row_number() OVER (PARTITION BY source, agent_id ORDER BY coalesce(act, TIMESTAMP '0001-01-01') DESC, machine) AS rk,
    bool_or(needs_user) OVER (PARTITION BY source, agent_id) AS anyn,
    first_value(needs_user_reason) OVER (PARTITION BY source, agent_id ORDER BY needs_user DESC, coalesce(act, TIMESTAMP '0001-01-01') DESC, machine) AS nreason
  FROM cur
),
one AS (
  SELECT source, agent_id, machine, project, norm, status, last_activity, act, anyn AS needs_user,
    CASE WHEN needs_user THEN needs_user_reason WHEN anyn THEN nreason END AS needs_user_reason FROM r1 WHERE rk = 1
),
grp AS (
  SELECT source, norm, count(*) = 2 AND min(machine) <> max(machine) AND count(act) = 2 AND max(act) - min(act) <= INTERVAL 5 DAY AS pair
  FROM one GROUP BY 1, 2
),
r2 AS (
  SELECT one.*, pair, row_number() OVER (PARTITION BY one.source, one.norm ORDER BY act DESC, machine, agent_id) AS rk,
    bool_or(needs_user) OVER (PARTITION BY one.source, one.norm) AS anyn,
    first_value(needs_user_reason) OVER (PARTITION BY one.source, one.norm ORDER BY needs_user DESC, act DESC, machine, agent_id) AS nreason
  FROM one JOIN grp ON grp.source = one.source AND grp.norm = one.norm
),
logical AS (
  SELECT source, agent_id, machine, project, status, last_activity, source || '/' || agent_id AS logical_key,
    CASE WHEN pair THEN anyn ELSE needs_user END AS needs_user,
    CASE WHEN NOT pair OR needs_user THEN needs_user_reason WHEN anyn THEN nreason END AS needs_user_reason
  FROM r2 WHERE NOT pair OR rk = 1
)
"""


def sql(*parts: str) -> str:
    """CTE parts, then the final SELECT."""
    if len(parts) == 1:
        return parts[0].strip()
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()
