"""cumulus: cumulative daily series per place, as lazy Spark DataFrame jobs.

Sub-packages:

* ``functions`` -- Column expressions (parsing, dates, arrays, text repair).
* ``sources``   -- CSV readers for wide series files, raw quoted lines, catalogue.
* ``sinks``     -- CSV writer.
* ``operators`` -- DataFrame-to-DataFrame jobs: cleaning, reshaping, merging, growth.
* ``plans``     -- the named trend queries, fixture derivation, query catalogue.
* ``streaming`` -- the same cleaning applied to a file stream of observation logs.

Every public function takes and returns DataFrames and runs no Spark action,
except where a docstring says so (reading a CSV header, learning the width
of an unpacked output).
"""

__version__ = "0.1.0"
