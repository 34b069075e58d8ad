"""Expressions as Spark SQL text.

Every function takes and returns SQL text, so expressions nest by plain string
formatting and reach Catalyst in one ``F.expr`` or ``selectExpr`` call.
"""
