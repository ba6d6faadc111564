"""arbitra: typed text decisions as Spark jobs.

Featurise -> train -> score -> calibrate -> decide -> evaluate -> gate, each
step taking and returning DataFrames.
"""

__version__ = "0.1.0"
