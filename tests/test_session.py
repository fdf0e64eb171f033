from tableflow.session import cluster_conf, scratch_path, shared_dir


def test_cluster_conf_sizes_partitions_from_input():
    conf = cluster_conf(100 * 2**40, 8000)  # 100 TiB on 8000 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409_600  # ~256 MiB each
    small = cluster_conf(2**30, 100)  # 1 GiB: at least 3 partitions per core
    assert int(small["spark.sql.shuffle.partitions"]) == 300
    assert int(conf["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]) == 4 * 256 * 2**20


def test_scratch_paths_are_fresh_and_under_the_shared_folder(spark):
    base = shared_dir(spark)
    a, b = scratch_path(spark, "x[1]"), scratch_path(spark, "x[1]")
    assert a != b and a.startswith(base) and "[" not in a
