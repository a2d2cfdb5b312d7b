"""All registered queries of the ledger operators."""

from ledgerlens.plans import q_audit, q_joins, q_labels, q_monitor, q_profile, q_quality, q_rules, q_streams

MODULES = (q_profile, q_joins, q_quality, q_labels, q_monitor, q_streams, q_rules, q_audit)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
