"""Dataset building and cleaning as Spark DataFrame operators.

Layers:

* ``functions``  -- column expressions (text, casts, formats, URLs, names)
* ``sources``    -- page corpus reader and dataset writers
* ``operators``  -- DataFrame -> DataFrame operators (extract, clean, profile)
* ``plans``      -- automatic cleaning, saved recipes, version history
* ``streaming``  -- the row-local operators on a streaming DataFrame
"""

__version__ = "0.1.0"
