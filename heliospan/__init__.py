"""Spark-native analytics for fleets of solar systems.

Every operator is a plain ``DataFrame -> DataFrame`` or ``Column -> Column``
function; Catalyst picks the physical plan.
"""
