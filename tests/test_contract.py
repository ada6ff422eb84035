"""Session helpers and the bench's output contract."""
import json
import os
import subprocess
import sys

from pagesift.session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class _Ctx:
    def __init__(self, current=None):
        self.dir, self.set_calls = current, []

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.set_calls.append(d)
        self.dir = d


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Session:
    def __init__(self, ctx_dir=None, conf_dir=None):
        self.sparkContext, self.conf = _Ctx(ctx_dir), _Conf(conf_dir)


def test_checkpoint_dir_prefers_the_cluster_setting():
    s = _Session(ctx_dir="hdfs:///shared/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt" and s.sparkContext.set_calls == []
    s = _Session(conf_dir="s3a://bucket/ckpt")
    assert ensure_checkpoint_dir(s) == "s3a://bucket/ckpt" and s.sparkContext.set_calls == ["s3a://bucket/ckpt"]
    s = _Session()
    local = ensure_checkpoint_dir(s)  # unset: a scratch folder, as in tests
    assert os.path.isdir(local) and s.sparkContext.set_calls == [local]


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_QUALITY="0", BENCH_REPS="1",
               BENCH_CPUS="4")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "page_gate", "events"],
                         capture_output=True, text=True, env=env, cwd="/tmp", timeout=600)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert out.returncode == 0 and len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"page_gate", "events"} and rec["value"] > 0


def test_classifier_beats_length_rule(spark):
    """SURVEY §5 (4): cross-validated F1 of the classifier exceeds the length rule's."""
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    cv = [r for r in E.queries()["cv_metrics"](spark, sf).collect() if r["fold"] is None][0]
    rule = [r for r in E.queries()["rule_f1"](spark, sf).collect() if r["lang"] is None][0]
    assert rule["f1"] < 0.3 and cv["f1"] > rule["f1"] + 0.2
