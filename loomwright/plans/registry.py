"""All queries of the engine by name, and the SQL that they are compared with."""

from . import answers, documents, flows, ingest, retrieval, runs, toc

MODULES = (retrieval, documents, ingest, runs, flows, toc, answers)


def merged(dicts) -> dict:
    """One dict of all; a name that two of them have is an error."""
    out: dict = {}
    for d in dicts:
        if twice := out.keys() & d.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= d
    return out


QUERIES: dict = merged(m.QUERIES for m in MODULES)
ORACLES: dict = merged(m.ORACLES for m in MODULES)
