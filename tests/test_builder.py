"""Split folders from task files."""

from shotgrove.sinks.builder import build_splits
from shotgrove.sources.files import read_csv_rows


def lines(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def test_folders_of_all_tasks_and_seeds(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    rows = {"sst-2": [f"text {i}\t{i % 2}" for i in range(40)],
            "sts-b": [f"{i}\ta\tb\tc\td\te\tf\ttext {i}\tother {i}\t{i / 8}" for i in range(40)]}
    for task, body in rows.items():
        (data / task).mkdir(parents=True)
        for name in ("train", "dev"):
            (data / task / f"{name}.tsv").write_text("\n".join(["header line", *body]) + "\n")
    (data / "mr").mkdir()
    for name in ("train", "test"):
        (data / "mr" / f"{name}.csv").write_text("".join(f'{i % 2},"a ""quoted"", text {i}"\n' for i in range(30)))
    folders = build_splits(spark, str(data), str(out), ("sst-2", "sts-b", "mr"), (13, 42), 4)
    assert len(folders) == 6 and str(out / "k-shot" / "sst-2" / "4-13") in folders
    for task in ("sst-2", "sts-b"):
        for seed in (13, 42):
            folder = f"{out}/k-shot/{task}/4-{seed}"
            train, dev = lines(spark, f"{folder}/train.tsv"), lines(spark, f"{folder}/dev.tsv")
            assert train[0] == dev[0] == "header line" and len(train) == len(dev) == 9
            assert set(train[1:]) <= set(rows[task]) and not set(train[1:]) & set(dev[1:])
            high = sum(float(line.split("\t")[-1]) >= (2.5 if task == "sts-b" else 1) for line in train[1:])
            assert high == 4
            assert lines(spark, f"{folder}/test.tsv") == ["header line", *rows[task]]
    csv = spark.read.schema("label string, text string").options(quote='"', escape='"').csv(f"{folders[-1]}/train.csv")
    assert csv.count() == 8 and csv.where("label = '1'").count() == 4
    assert all(r["text"].startswith('a "quoted", text') for r in csv.collect())


def test_tasks_with_two_dev_files_and_without_header(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    for task, names in (("mnli", ("train", "dev_matched", "dev_mismatched")), ("cola", ("train", "dev"))):
        (data / task).mkdir(parents=True)
        for name in names:
            body = ([f"s\t{i % 2}\t*\t{name} {i}" for i in range(12)] if task == "cola" else
                    ["head", *[f"{i}\t{name}\t{('neutral', 'entailment', 'contradiction')[i % 3]}" for i in range(12)]])
            (data / task / f"{name}.tsv").write_text("\n".join(body) + "\n")
    old = out / "k-shot" / "cola" / "2-13" / "train.tsv"
    old.mkdir(parents=True)
    (old / "part-old.txt").write_text("old line\n")
    build_splits(spark, str(data), str(out), ("mnli", "cola"), (13,), 2)
    mnli, cola = f"{out}/k-shot/mnli/2-13", f"{out}/k-shot/cola/2-13"
    assert lines(spark, f"{mnli}/test_mismatched.tsv")[:2] == ["head", "0\tdev_mismatched\tneutral"]
    assert len(lines(spark, f"{mnli}/test_matched.tsv")) == 13 and len(lines(spark, f"{mnli}/train.tsv")) == 7
    train = lines(spark, f"{cola}/train.tsv")
    assert [line.split("\t")[1] for line in train] == ["0", "0", "1", "1"] and "old line" not in train
    assert len(lines(spark, f"{cola}/dev.tsv")) == 4 and len(lines(spark, f"{cola}/test.tsv")) == 12
    assert sorted(p.name for p in out.iterdir()) == ["k-shot"]


def test_large_test_files_keep_their_order_over_many_tasks(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    (data / "cr").mkdir(parents=True)
    for name, n in (("train", 20), ("test", 3000)):
        (data / "cr" / f"{name}.csv").write_text("".join(f'{i % 2},"text {i},\nsecond ""line"""\n' for i in range(n)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = build_splits(spark, str(data), str(out), ("cr",), (13,), 3)[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((out / "k-shot" / "cr" / "3-13" / "test.csv").glob("part-*"))) > 1
    read = read_csv_rows(spark, f"{folder}/test.csv").orderBy("line_no").collect()
    assert [r["text"] for r in read] == [f'text {i},\nsecond "line"' for i in range(3000)]
