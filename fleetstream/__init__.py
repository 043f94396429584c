"""fleetstream: file-driven stream processing and cluster telemetry on Spark.

Modules:

* ``fleetstream.functions`` -- ``parsers``, ``formats``, ``envelope``, ``paths``:
  Column expressions for the log lines, message envelopes and paths.
* ``fleetstream.sources`` -- ``logs`` (run/host log folders), ``files`` (file
  listings, whole files, samples).
* ``fleetstream.operators`` -- ``timeline``, ``ordered``, ``selection``,
  ``slices``, ``messages``, ``tasks``, ``sinks``.
* ``fleetstream.streaming.newfiles`` -- the new-file stream.
* ``fleetstream.plans`` -- ``analysis`` (log folders -> figure series),
  ``catalog`` / ``oracle`` (registered queries and their SQL), ``fixtures``.
* ``fleetstream.cli`` -- command line (``python -m fleetstream.cli``).
"""

__version__ = "0.1.0"
