"""Plain Python versions of the operators, written from the problem statements."""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import datetime, timezone


def _micros(stamp):
    try:
        return round(datetime.fromisoformat(stamp.replace("Z", "+00:00")).astimezone(timezone.utc).timestamp() * 1e6)
    except (AttributeError, ValueError):
        return None


def _blank(message):
    content = message.get("content") if isinstance(message, dict) else None
    if content is None:
        return True
    if isinstance(content, str):
        return not content.strip()
    if isinstance(content, list):
        for b in content:
            if isinstance(b, dict):
                if b.get("type", "text") != "text" or str(b.get("text") or "").strip():
                    return False
            elif isinstance(b, str):
                if b.strip():
                    return False
            elif b is not None:
                return False
        return True
    return False


def conversations(rows):
    """rows: (transcript_id, generation, seq, v) -> {(transcript_id, side): reason or None}"""
    entries, loose = {}, []
    for t, g, seq, v in sorted(rows, key=lambda r: (r[1] or 0, r[2] if r[2] is not None else 1 << 62)):
        try:
            j = json.loads(v)
        except (TypeError, ValueError):
            continue
        if not isinstance(j, dict):
            continue
        if j.get("uuid") is None:
            loose.append((t, seq, j))
        else:
            entries.setdefault(j["uuid"], (t, seq, j))
    every = [*entries.values(), *loose]
    known = {(t, j.get("uuid")) for t, _, j in every}
    talks = defaultdict(list)
    for t, seq, j in every:
        if j.get("type") in ("user", "assistant"):
            side = 1 if str(j.get("isSidechain")).strip().lower() in ("true", "1") else 0
            at = _micros(j.get("timestamp"))
            talks[t, side].append((at is None, at, seq, j))
    out = {}
    for key, messages in talks.items():
        messages.sort(key=lambda m: m[:3])
        spoken = [m[3]["message"] for m in messages if not _blank(m[3].get("message"))]
        roles = [m.get("role") for m in spoken]
        reason = None
        if not spoken:
            reason = "empty"
        elif (
            any(m[3].get("parentUuid") is not None and (key[0], m[3]["parentUuid"]) not in known for m in messages)
            or any(r not in ("user", "assistant") for r in roles)
            or roles[0] == "assistant"
        ):
            reason = "broken"
        elif any(r == "user" and (i + 1 == len(roles) or roles[i + 1] == "user") for i, r in enumerate(roles)):
            reason = "missing_reply"
        out[key] = reason
    return out
