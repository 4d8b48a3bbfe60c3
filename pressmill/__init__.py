"""pressmill: news-harvest analytics on Spark.

Landed search results, feeds and pages become a clean, de-duplicated,
language-tagged and triaged article table. Every operator is a
``DataFrame -> DataFrame`` (or ``Column -> Column``) function; nothing is
collected to the driver.
"""

from pressmill.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
