"""Property-graph analytics and training-data preparation on Spark DataFrames.

With ``ARCWEAVE_DEBUG`` set (to anything but 0 or false), log messages of level DEBUG
are shown: the written steps of loops with their folders.
"""

import logging
import os

if os.environ.get("ARCWEAVE_DEBUG", "").lower() not in ("", "0", "false"):
    logging.basicConfig(level=logging.DEBUG)
