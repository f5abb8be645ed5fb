"""All registered queries with their SQL twins."""

from __future__ import annotations

from slotflow.checks import asked, flow, planning, records, slots, streams

MODULES = [slots, flow, records, planning, asked, streams]


def registered() -> dict:
    out: dict = {}
    for module in MODULES:
        clash = out.keys() & module.CHECKS.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(module.CHECKS)
    return out
