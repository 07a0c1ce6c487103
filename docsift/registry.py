"""Named queries over the tables of one folder, and their SQL."""

from __future__ import annotations

from docsift.plans import agent, contract, evaluate, evidence, matching, native, nested, quality, retrieval, salvage, scoring, selection

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in (retrieval, quality, evaluate, evidence, agent, scoring, native, contract, matching, selection, salvage, nested):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
