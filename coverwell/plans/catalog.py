"""All queries and their SQL: importing the modules of queries fills the registry."""

from coverwell.plans import desk, flows, registry, wires

assert desk and flows and wires
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
