"""The state monitor rules written directly as a loop over one key's history, to check the DataFrame operators against."""

from datetime import datetime, timezone

TAGS = ("tag1", "tag2", "tag3")


def has_all_tags(wanting, candidate):
    return all(wanting[t] is None or wanting[t] == candidate[t] for t in TAGS)


def nulls_first(value):
    return (value is not None, value or "")


def order_of(rules):
    rank = {s.name: i for i, s in enumerate(rules.states)}
    return lambda t: (
        t["timestamp"],
        nulls_first(t["streamid"]),
        nulls_first(t["eventid"]),
        not t["open"],
        rank[t["state"]],
        *[nulls_first(t[x]) for x in TAGS],
    )


def replay(history, rules, now, last_run=None, judged=()):
    """Returns (new judgements as {identity: (required, emitted)}, the first ambiguous close or None)."""
    distinct = [dict(x) for x in {tuple(sorted(t.items(), key=lambda kv: kv[0])) for t in history}]
    opened, found, warned = [], {}, None
    done = set(judged)
    for t in sorted(distinct, key=order_of(rules)):
        state = rules.state(t["state"])
        if t["open"]:
            opened.append(t)
            for need in state.open.requires:
                latency = rules.state(need).max_latency
                if identity(t) in done or not now > t["timestamp"] + latency:
                    continue
                if any(o["state"] == need and has_all_tags(t, o) for o in opened):
                    continue
                done.add(identity(t))
                in_time = now <= t["timestamp"] + state.open.timeout
                first_look = last_run is None or last_run <= t["timestamp"] + latency
                found[identity(t)] = (need, in_time and first_look)
        else:
            hits = [o for o in opened if o["state"] == t["state"] and has_all_tags(t, o)]
            if len(hits) > 1 and state.strategy == "warn":
                if warned is None and t["timestamp"] <= now:
                    warned = (identity(t), sorted((identity(h) for h in hits), key=repr))
                continue
            if state.strategy == "pop":
                hits = hits[:1]
            opened = [o for o in opened if not any(o is h for h in hits)]
    return found, warned


def identity(t):
    return tuple(t[c] for c in ("key", "timestamp", "state", "tag1", "tag2", "tag3", "eventid", "streamid"))


def at(text):
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)


def replay_runs(runs, rules, horizon):
    """Runs over time: ``runs`` is [(now, rows that arrived since the last run)]. After each run, what is older than
    ``horizon`` before it is forgotten. Returns per run (new judgements, newly warned keys)."""
    held, judged, warned, last, out = [], {}, set(), None, []
    for now, arrived in runs:
        held += arrived
        new, warnings = {}, set()
        for key in {t["key"] for t in held}:
            found, ambiguous = replay([t for t in held if t["key"] == key], rules, now, last, judged)
            new.update(found)
            if ambiguous and key not in warned:
                warnings.add(key)
        judged.update(new)
        warned |= warnings
        out.append((new, warnings))
        held = [t for t in held if not now > t["timestamp"] + horizon]
        judged = {i: v for i, v in judged.items() if not now > i[1] + horizon}
        last = now
    return out
