"""Fixed values, session helpers and the shared scratch location."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# --- fixed values that must equal the audited pipeline's (stated as data) ---
# Identity-group columns, in their fixed order.
GROUPS = [
    "black",
    "white",
    "christian",
    "female",
    "male",
    "homosexual_gay_or_lesbian",
    "jewish",
    "muslim",
    "psychiatric_or_mental_illness",
]
BASE_COLUMNS = ["id", "target", "comment_text"]
# Sentinel written into every group column of a row that had any null group.
NULL_SENTINEL = -1.0
# Minimum rows *per class* for a group to be scored.
MIN_GROUP_SIZE = 50
# Strict threshold that turns a score into a class label.
LABEL_THRESHOLD = 0.5
# Profiling ranges of the target (half-open), for 2 and 4 ranges.
TARGET_RANGES = {
    2: [(0.0, 0.5), (0.5, 1.0)],
    4: [(0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.0)],
}
# Down-sampling strata and the share of rows dropped in each.
DROP_RANGES = [(0.0, 0.01), (0.01, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.0)]
DROP_SHARES_WITH_NULLS = [0.98, 0.85, 0.7, 0.0, 0.0]
DROP_SHARES_WITHOUT_NULLS = [0.91, 0.5, 0.4, 0.0, 0.0]
# Chained split sizes: first test share per stratum, then the calib/rest and eval/test shares.
SPLIT_FIRST_TEST_SHARE = {"with_nulls": 0.25, "without_nulls": 0.5}
SPLIT_SECOND_TEST_SHARE = 0.67
SPLIT_THIRD_TEST_SHARE = 0.5
# Metric directions used by the worst/best/mean group summary.
LOWER_IS_BETTER = ["loss_nll", "loss_stddev", "loss_cdf", "FPR"]
HIGHER_IS_BETTER = ["Accuracy", "F1", "TPR", "Precision", "Recall"]
MEAN_METRICS = ["loss_nll", "loss_stddev", "loss_cdf", "Accuracy", "F1", "TPR", "FPR", "Precision", "Recall"]
METRIC_NAMES = ["loss", "loss_cdf", "loss_stddev", "loss_nll", "Recall", "FPR", "Precision", "F1", "Accuracy"]
# Sweep grid and training defaults.
SWEEP_LEARNING_RATES = [1e-4]
SWEEP_COEFFICIENTS = [0.0, 0.06, 0.2, 0.4, 0.6, 0.8, 1.0]
DEFAULT_COEFFICIENT = 0.8
DEFAULT_SEED = 42
TRAIN_BATCH_SIZE = 8
# A training step's rows: batches of TRAIN_BATCH_SIZE on 8 devices.
GLOBAL_BATCH_SIZE = 8 * TRAIN_BATCH_SIZE
EVAL_BATCH_SIZE = 64
NUM_EPOCHS = 3
WARMUP_RATIO = 0.1
PATIENCE = 3
EVAL_STEPS = 500
MAX_SEQ_LEN = 512
CALIB_BATCH_SIZE = 1000
CALIB_LR = 0.01
PIT_CLIP = 1e-6
HIST_BINS = 30
HIST_ZOOM_MIN = 0.1
# Key of the unbalanced whole-table row in long metric tables.
OVERALL = "ALL"


def get_session(master: str | None = None, app: str = "calibrix", **conf) -> SparkSession:
    """Session with the settings the library is tuned for (AQE on, UI off, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Generated-code cache: a session running many query shapes keeps their compiled stages
        # (the default of 100 entries is exceeded by a few multi-stage queries, forcing recompiles).
        "spark.sql.codegen.cache.maxEntries": "2000",
        "spark.driver.memory": "16g",
    }
    defaults.update(conf)
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint dir);
    only when neither is set (unit tests) is a private folder created and registered.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root:
            sc.setCheckpointDir(root)
            root = sc.getCheckpointDir() or root
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: streams, written "
                               "intermediate tables and checkpoints need storage every executor sees")
        # Local sessions (tests) only: a private folder on this machine, gone when the process ends.
        root = tempfile.mkdtemp(prefix="calibrix-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str, *key_parts) -> str:
    """A path under the checkpoint root for (name, key): the same for the same key in every session."""
    digest = hashlib.sha1("|".join(map(str, key_parts)).encode()).hexdigest()[:16]
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/calibrix/{name}/{digest}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint root that no other call has."""
    return scratch_path(spark, name, uuid.uuid4().hex)


def path_exists(spark: SparkSession, uri: str) -> bool:
    """Existence check through the Hadoop FileSystem, so it works on any shared store."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(conf).exists(p)


def code_fingerprint() -> str:
    """Digest of this package's source: part of cache keys, so a table cached by other code is
    never read back."""
    root = os.path.dirname(os.path.abspath(__file__))
    h = hashlib.sha1()
    for dirpath, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode() + fh.read())
    return h.hexdigest()[:16]
