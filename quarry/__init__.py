"""quarry: Spark-native jobs for building and judging question-to-query data.

Every public function takes and returns a ``DataFrame`` or a ``Column``; the
work is declared with the DataFrame / SQL API and planned by Catalyst.
"""

from quarry.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
