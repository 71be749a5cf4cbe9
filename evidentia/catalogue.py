"""Every query of the library by name, and the SQL that gives the same rows."""

from .plans import files, findings, program, shortlists

QUERIES = {**shortlists.QUERIES, **findings.QUERIES, **program.QUERIES, **files.QUERIES}
ORACLES = {**shortlists.ORACLES, **findings.ORACLES, **program.ORACLES, **files.ORACLES}
