import os

import pytest

from pairlab import session


def test_stored_copies_and_their_removal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda s: str(tmp_path))
    kept = session.materialise(spark.range(10), "x")
    assert kept.count() == 10 and "parquet" in kept.inputFiles()[0]
    other = tmp_path / "pairlab" / "another-application"
    other.mkdir()
    session.drop_intermediates(spark)
    assert other.exists() and not os.path.exists(session.run_folder(spark))


def test_shared_folder_is_required_on_a_cluster(spark):
    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session)
    Session.conf = type("C", (), {"get": staticmethod(lambda key, default: "file:/tmp/x")})
    with pytest.raises(ValueError, match="one machine"):
        session.scratch_root(Session)
    Session.conf = type("C", (), {"get": staticmethod(lambda key, default: "hdfs://store/x/")})
    assert session.scratch_root(Session) == "hdfs://store/x"
    Session.conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
    Context.master = "local[2]"
    assert session.scratch_root(Session) == session.scratch_root(Session)


def test_a_mounted_folder_counts_as_shared_on_a_cluster(spark, tmp_path):
    class Context:
        master, applicationId = "spark://host:7077", "mounted"

    class Session:
        sparkContext, range, read, _jsc = Context, staticmethod(spark.range), spark.read, spark._jsc

    def holds(**conf):
        Session.conf = type("C", (), {"get": staticmethod(lambda key, default: conf.get(key.split(".")[-2], default))})
        return session.scratch_root(Session)

    assert holds(checkpoint=f"file:{tmp_path}/a/") == f"file:{tmp_path}/a"
    assert holds(checkpoint=f"{tmp_path}/a/") == f"{tmp_path}/a"
    # without a checkpoint folder the warehouse is the shared one
    assert holds(warehouse=f"file:{tmp_path}/b") == f"file:{tmp_path}/b"
    with pytest.raises(ValueError, match="one machine"):
        holds(checkpoint="file:/proc/nowhere")


def test_a_local_cluster_without_a_checkpoint_folder_uses_what_its_executors_share(spark, tmp_path):
    class Context:
        master, applicationId = "local-cluster[3,4,1024]", "local-cluster"

    class Session:
        sparkContext, range, read, _jsc = Context, staticmethod(spark.range), spark.read, spark._jsc
        conf = type("C", (), {"get": staticmethod(lambda key, default: f"file:{tmp_path}/w" if "warehouse" in key else default)})

    # not the driver's temp folder, which an executor need not see
    assert session.scratch_root(Session) == f"file:{tmp_path}/w"
    Context.getCheckpointDir = staticmethod(lambda: f"file:{tmp_path}/set")
    assert session.scratch_root(Session) == f"file:{tmp_path}/set"
