"""loanscope: consumer-loan portfolio analytics as Spark jobs.

Layout
------
sources/    loan table: CSV import, the loan view over the driver tables,
            the materialised loan table, report sink
functions/  column expressions: exact rounding, month text, banding, text form
operators/  DataFrame -> DataFrame building blocks: shares, two-grain
            averages, lag ratio, top-per-group, profiling, dense row ids, P&L
plans/      the reports themselves (one function per report) and the registry
streaming/  the additive reports kept current over a growing loan folder
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
