"""evidara: evidence analytics on Spark DataFrames.

Every operator is a plain function from DataFrame(s) to DataFrame.  Tables carry
``workspace_id`` as the leading key, so one job serves all workspaces at once, and
an explicit ``ord`` column wherever insertion order is part of the meaning.
"""

__version__ = "0.1.0"
