"""Plain SQL statements of the registered queries, over the given tables."""

EV = """
ev AS (
  SELECT event_id, ts, event_type, value, 'User' || user_id AS key,
         strftime(ts, '%Y%m%d') AS streamid, CAST(event_id AS VARCHAR) AS eventid,
         'Domain' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 3) AS domain,
         'Device' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 4) AS device,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'Login'
              WHEN event_type IN ('view', 'click') THEN 'Logout'
              WHEN event_type = 'error' THEN 'Authentication Failure' END AS operation,
         CASE WHEN event_type IN ('signup', 'view') THEN 'GATE' ELSE 'LEDGER' END AS system
  FROM events)"""

FAIL = EV + """,
fail AS (SELECT * FROM ev WHERE operation = 'Authentication Failure')"""


def tr(open_tag2: str = "NULL", close_tag2: str = "NULL") -> str:
    """Transitions of the monitor rules: tag1 is the domain, tag2 the device where a rule defines it."""
    return EV + f""",
tr AS (
  SELECT key, ts, event_id, eventid, streamid, CASE WHEN system = 'GATE' THEN 'gate' ELSE 'ledger' END AS state,
         operation = 'Login' AS open, domain AS tag1,
         CASE WHEN operation = 'Login' THEN {open_tag2} ELSE {close_tag2} END AS tag2
  FROM ev WHERE operation IN ('Login', 'Logout'))"""


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# The gate opens that are open at ledger opening o, by strategy; each is a condition on o.
NOTHING_OPEN_CLOSE = """NOT EXISTS (
    SELECT 1 FROM tr r WHERE r.key = o.key AND r.state = 'gate' AND r.open
      AND (r.ts, r.event_id) <= (o.ts, o.event_id) AND (o.tag1 IS NULL OR r.tag1 = o.tag1)
      AND NOT EXISTS (
        SELECT 1 FROM tr c WHERE c.key = r.key AND c.state = 'gate' AND NOT c.open
          AND (c.ts, c.event_id) > (r.ts, r.event_id) AND (c.ts, c.event_id) < (o.ts, o.event_id)
          AND (c.tag1 IS NULL OR c.tag1 = r.tag1)))"""

# pop, closes and opens with the same tag: the number open is the running sum lifted by its lowest point.
POP_LEVELS = """,
runs AS (
  SELECT key, tag1, ts, event_id,
         sum(CASE WHEN open THEN 1 ELSE -1 END) OVER (PARTITION BY key, tag1 ORDER BY ts, event_id) AS s
  FROM tr WHERE state = 'gate'),
levels AS (
  SELECT key, tag1, ts, event_id, s - least(0, min(s) OVER (PARTITION BY key, tag1 ORDER BY ts, event_id)) AS alive
  FROM runs)"""
NOTHING_OPEN_POP = """coalesce((
    SELECT arg_max(l.alive, l.ts) FROM levels l WHERE l.key = o.key AND l.tag1 = o.tag1 AND l.ts <= o.ts), 0) = 0"""

# pop, closes with the domain only, opens with domain and device: the i-th open of a domain ends at the i-th close that
# found something open.
POP_PARTIAL = """,
steps AS (
  SELECT *, sum(CASE WHEN open THEN 1 ELSE -1 END) OVER w AS s, count(*) FILTER (open) OVER w AS opens,
         count(*) FILTER (NOT open) OVER w AS closes
  FROM tr WHERE state = 'gate' WINDOW w AS (PARTITION BY key, tag1 ORDER BY ts, event_id)),
lows AS (
  SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY key, tag1 ORDER BY ts, event_id
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM steps),
spans AS (
  SELECT r.key, r.tag1, r.tag2, r.ts, c.ts AS until
  FROM lows r LEFT JOIN lows c ON c.key = r.key AND c.tag1 = r.tag1 AND NOT c.open AND c.s >= c.low
                              AND c.closes + c.low = r.opens
  WHERE r.open)"""
NOTHING_OPEN_POP_PARTIAL = """NOT EXISTS (
    SELECT 1 FROM spans r WHERE r.key = o.key AND r.tag1 = o.tag1 AND r.tag2 = o.tag2
      AND r.ts < o.ts AND (r.until IS NULL OR r.until > o.ts))"""

# warn: from the second of two successive opens on, nothing of that (key, domain) closes any more.
WARN_SPANS = """,
seen AS (
  SELECT *, lag(open) OVER w AS before,
         count(*) FILTER (open) OVER (PARTITION BY key, state, tag1 ORDER BY ts, event_id) AS opens
  FROM tr WINDOW w AS (PARTITION BY key, state, tag1 ORDER BY ts, event_id)),
stuck AS (
  SELECT key, state, tag1, min(ts) AS since, min(opens) AS nth
  FROM seen WHERE open AND before GROUP BY ALL),
spans AS (
  SELECT r.key, r.tag1, r.ts,
         (SELECT min(c.ts) FROM tr c WHERE c.key = r.key AND c.state = r.state AND c.tag1 = r.tag1 AND NOT c.open
            AND c.ts > r.ts AND (k.since IS NULL OR c.ts < k.since)) AS until
  FROM tr r LEFT JOIN stuck k USING (key, state, tag1)
  WHERE r.state = 'gate' AND r.open)"""
NOTHING_OPEN_WARN = """NOT EXISTS (
    SELECT 1 FROM spans r WHERE r.key = o.key AND r.tag1 = o.tag1
      AND r.ts < o.ts AND (r.until IS NULL OR r.until > o.ts))"""




def mixed(strategy: str) -> str:
    """The gate's opens replayed step by step, as a list that each transition of a key changes: closes set the domain, and the
    device only if it is an even one. ``rt`` has the transitions with those tags, ``spans`` when each open ended."""
    match = "list_filter(s.opened, lambda x: x.tag1 = n.tag1 AND (n.tag2 IS NULL OR x.tag2 = n.tag2))"
    ended = f"CASE WHEN len({match}) = 1 THEN {match}[1].event_id END" if strategy == "warn" else f"{match}[1].event_id"
    return f""",
rt AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS nr FROM tr WHERE state = 'gate'),
steps AS (
  SELECT key, CAST(0 AS BIGINT) AS nr, CAST([] AS STRUCT(event_id BIGINT, tag1 VARCHAR, tag2 VARCHAR)[]) AS opened,
         CAST(NULL AS BIGINT) AS ended, CAST(NULL AS TIMESTAMP) AS at FROM rt WHERE nr = 1
  UNION ALL
  SELECT key, nr, CASE WHEN open THEN list_append(opened, {{'event_id': event_id, 'tag1': tag1, 'tag2': tag2}})
                       ELSE list_filter(opened, lambda x: ended IS NULL OR x.event_id <> ended) END AS opened, ended, ts AS at
  FROM (SELECT s.key, n.nr, n.open, n.event_id, n.tag1, n.tag2, n.ts, s.opened, CASE WHEN NOT n.open THEN {ended} END AS ended
        FROM steps s JOIN rt n ON n.key = s.key AND n.nr = s.nr + 1) m),
spans AS (
  SELECT r.key, r.tag1, r.tag2, r.ts, c.at AS until
  FROM rt r LEFT JOIN steps c ON c.key = r.key AND c.ended = r.event_id WHERE r.open)"""


NOTHING_OPEN_MIXED = """NOT EXISTS (
    SELECT 1 FROM spans r WHERE r.key = o.key AND r.tag1 = o.tag1 AND r.tag2 = o.tag2
      AND r.ts < o.ts AND (r.until IS NULL OR r.until > o.ts))"""


def missing(ctes: str, condition: str, as_of: str = AS_OF) -> str:
    return f"""WITH {ctes}
SELECT o.key, o.ts AS opened_at, o.state, o.tag1, o.tag2, o.eventid, o.streamid, 'gate' AS required_state
FROM tr o
WHERE o.state = 'ledger' AND o.open AND o.ts + INTERVAL 2 DAY < {as_of} AND {as_of} <= o.ts + INTERVAL 9 DAY
  AND {condition}"""


MISSING_CLOSE = missing(tr(), NOTHING_OPEN_CLOSE)
