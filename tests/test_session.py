import os

import pytest

from riskweave import session


def test_checkpoint_folder_does_not_nest(spark):
    base = session.ensure_checkpoint_dir(spark)
    for _ in range(300):
        assert os.path.dirname(session.scratch_path(spark, "t")) == base


def test_non_local_master_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
