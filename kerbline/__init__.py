"""kerbline: trip, weather, zone and street-advisory analytics on PySpark.

Every operator is a function from DataFrame(s) to DataFrame. Nothing here starts a
job on its own except the writers in ``sources.tables`` and the explicitly named
size check in ``operators.joins``.
"""
