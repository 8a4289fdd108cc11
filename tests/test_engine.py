import json
import os
import zipfile
from datetime import datetime

import pytest

from ledgerlane.operators import integrity
from ledgerlane.plans.engine import Config, Engine, evidence_index, run_batches, run_evidence_pack, run_timing_analysis, safe_run
from ledgerlane.sources import catalogue, files, sinks, storage

PAYROLL = "Emp ID,Check Date,EE Deferral $,EE Roth $,Loan Repay $,is_hce,catchup_pretax,catchup_roth,age\n1,2025-01-03,\"$1,000.00\",0,50,Y,500,0,55\n2,01/03/2025,200,50,0,N,0,0,30\n,2025-01-03,7,0,0,N,0,0,30\n"
RK = "Part_ID,Post_Date,EE_PreTax,EE_Roth,Loan_Contr\n1,2025-01-06,1000,0,45\n2,2025-01-20,200,50,0\n3,2025-01-06,5,0,0\n"


@pytest.fixture
def sides(spark, tmp_path):
    for name, text in (("p.csv", PAYROLL), ("r.csv", RK)):
        (tmp_path / name).write_text(text)
    return [files.read_table(spark, str(tmp_path / n)) for n in ("p.csv", "r.csv")]


def test_run_writes_sealed_results(spark, sides, tmp_path):
    result = Engine(spark, Config(plan_name="P", single_files=True)).run(*sides, output=str(tmp_path / "out"))
    s = result.summary
    assert (s["payroll_vendor"][0], s["rk_vendor"][0]) == ("ADP", "VENDOR_RK_1")
    assert (s["deferral_mismatch_count"], s["loan_mismatch_count"], s["late_deferral_count"], s["only_rk_count"]) == (0, 1, 1, 1)
    assert float(s["total_deferrals_payroll"]) == 1250.0 and s["plan_year"] == 2025
    assert {r["violation_type"] for r in result.tables["secure20_issues"].collect()} == {"HCE catch-up not coded as Roth"}
    with zipfile.ZipFile(result.files["evidence_pack"]) as z:
        assert {"run_summary.json", "deferral_mismatches.csv", "results.csv", "violations.csv", "audit_summary.txt", "manifest.json", "README.txt"} <= set(z.namelist())
    manifest = result.files["manifest"]
    assert set(integrity.verify(manifest).values()) == {"ok"}
    with open(result.files["loan_mismatches"], "a") as f:
        f.write("x")
    assert integrity.verify(manifest)["loan_mismatches"] == "changed"
    assert len(json.load(open(manifest))["merkle_roots"]["recon_deferrals"]) == 64
    assert any(w.startswith("match") for w in result.warnings) and {e["category"] for e in evidence_index(result)} >= {"Timing", "Compliance"}


def test_rows_are_written_in_parts(spark, sides, tmp_path):
    given = {"payroll": str(tmp_path / "p.csv"), "recordkeeper": str(tmp_path / "r.csv")}
    result = Engine(spark, Config(plan_name="P")).run(*sides, output=str(tmp_path / "out"), inputs=given)
    folder = result.files["loan_mismatches"]
    parts = sinks.parts_of(folder)
    assert parts and parts != [folder] and files.read_csv(spark, folder).count() == 1
    assert sinks.parts_of(result.files["timing_summary"]) == [result.files["timing_summary"]]
    manifest = json.load(open(result.files["manifest"]))
    assert set(manifest["inputs"]) == {"payroll", "recordkeeper"}
    assert manifest["evidence_pack_sha256"] == integrity.sha256_file(result.files["evidence_pack"], "sha256:")
    with zipfile.ZipFile(result.files["evidence_pack"]) as z:
        assert z.testzip() is None
        assert json.loads(z.read("manifest.json"))["evidence_pack_sha256"] is None
        assert any(n.startswith("violations.csv/part-") for n in z.namelist())
        assert z.read("run_summary.json") == storage.read(result.files["run_summary"])
    proof = json.load(open(result.files["proofs"]))["recon_deferrals"]
    assert proof["row_count"] == 3 and len(proof["row_hash_sample"]) == 3 and proof["merkle_root"] == manifest["merkle_roots"]["recon_deferrals"]
    assert integrity.verify_proofs(result.files["proofs"], result.files) == {"recon_deferrals": "ok", "recon_loans": "ok"}
    # Every way in which a pack can differ from its manifest.
    with open(parts[0].removeprefix("file:"), "a") as f:
        f.write("x")
    os.remove(result.files["run_summary"])
    (tmp_path / "out" / "more.csv").write_text("a\n")
    odd = {k.split("/")[0] if "loan" in k else k.split("/")[-1]: v for k, v in integrity.verify(result.files["manifest"]).items() if v != "ok"}
    assert odd == {"loan_mismatches": "changed", "run_summary": "missing", "more.csv": "unlisted"}
    whole = [p for p in sinks.parts_of(result.files["recon_deferrals"]) if b"1250" in storage.read(p) or b"1000.00" in storage.read(p)][0].removeprefix("file:")
    text = open(whole).read()
    open(whole, "w").write(text.replace("1000.00", "1000.01"))
    os.remove(os.path.join(os.path.dirname(whole), f".{os.path.basename(whole)}.crc"))  # the store's own checksum
    assert integrity.verify_proofs(result.files["proofs"], result.files) == {"recon_deferrals": "changed", "recon_loans": "ok"}


def test_run_on_a_file_system_by_uri(spark, sides, tmp_path):
    output = f"file://{tmp_path}/by uri"
    result = Engine(spark, Config(plan_name="P", workbook=("recon_deferrals", "timing_summary"))).run(*sides, output=output, inputs={"payroll": f"file://{tmp_path}/p.csv"})
    assert not os.path.exists("file:")
    assert set(integrity.verify(result.files["manifest"]).values()) == {"ok"}
    with zipfile.ZipFile(tmp_path / "by uri" / "evidence_pack.zip") as z:
        assert any(n.startswith("loan_mismatches.csv/part-") for n in z.namelist()) and "timing_summary.csv" in z.namelist()
    book = files.read_table(spark, f"{output}/results.xlsx")
    assert sorted(r["employee_id"] for r in book.collect()) == ["1", "2", "3"]


def test_inputs_are_never_deleted(spark, tmp_path):
    """An output folder that holds an input is refused before anything is touched; what no manifest names stays."""
    out = tmp_path / "out"
    out.mkdir()
    for name, text in (("p.csv", PAYROLL), ("r.csv", RK)):
        (out / name).write_text(text)
        (tmp_path / name).write_text(text)
    inside = [files.read_table(spark, str(out / n)) for n in ("p.csv", "r.csv")]
    for inputs in ({"payroll": str(out / "p.csv")}, None):
        with pytest.raises(ValueError, match="holds inputs"):
            Engine(spark).run(*inside, output=str(out), inputs=inputs)
    assert sorted(os.listdir(out)) == ["p.csv", "r.csv"]
    sides = [files.read_table(spark, str(tmp_path / n)) for n in ("p.csv", "r.csv")]
    first = Engine(spark).run(*sides, output=str(out))
    Engine(spark, Config(secure20=False)).run(*sides, output=str(out))
    assert (out / "p.csv").exists() and (out / "r.csv").exists()
    assert not storage.exists(first.files["secure20_issues"])  # of the earlier run
    with pytest.raises(FileNotFoundError):
        Engine(spark).run(*sides, output=str(tmp_path / "other"), inputs={"payroll": str(tmp_path / "gone.csv")})
    with pytest.raises(FileNotFoundError, match="neither"):
        sinks.seal({"x": str(tmp_path / "nothing.csv")}, str(tmp_path / "z.zip"))


def test_data_quality_is_counted_in_the_run(spark, tmp_path):
    (tmp_path / "p.csv").write_text("employee_id,pay_date,EE Deferral $,Deferral,is_hce\n1,2025-01-03,5,9,maybe\n2,2025-01-03,5,9,Y\n ,2025-01-03,5,9,\n3,2025-01-03,5,9,1.0\n")
    (tmp_path / "r.csv").write_text("employee_id,deposit_date,amount\n1,2025-01-04,5\n,2025-01-04,5\n,2025-01-04,5\n")
    result = Engine(spark).run(*[files.read_table(spark, str(tmp_path / n)) for n in ("p.csv", "r.csv")])
    assert {k: result.summary[k] for k in ("bad_is_hce", "null_ids_payroll", "null_ids_rk")} == {"bad_is_hce": 1, "null_ids_payroll": 1, "null_ids_rk": 2}
    told = "\n".join(result.warnings)
    assert "neither yes nor no, taken as no: 1" in told and "recordkeeper rows without an id, left out: 2" in told and "'Deferral' left aside" in told


def test_entries(spark, sides, tmp_path):
    p, r = str(tmp_path / "p.csv"), str(tmp_path / "r.csv")
    got = run_timing_analysis(spark, p, r, str(tmp_path / "timing"))
    assert (got["total_rows"], got["late_rows"], got["missing_deposits"], got["timing_risk"]) == (2, 1, 0, "Medium")
    assert files.read_csv(spark, got["late_contributions_path"]).count() == 1
    assert json.loads(storage.read(got["timing_summary_path"]))["risk_level"] == "Medium"
    (tmp_path / "m.json").write_text(json.dumps({"payroll": {"id": {"canonical": "employee_id", "examples": ["Emp ID"]}, "d": {"canonical": "pay_date", "examples": ["Check Date"]}, "m": {"canonical": "EE Deferral $", "examples": ["EE Deferral $"]}}, "recordkeeper": {"id": {"canonical": "employee_id", "examples": ["Part_ID"]}, "m": {"canonical": "amount", "examples": ["EE_PreTax"]}}}))
    pack = run_evidence_pack(spark, p, r, str(tmp_path / "m.json"), str(tmp_path / "packs"), Config(plan_name="P", catalogue=str(tmp_path / "runs")))
    assert set(pack["manifest"]["inputs"]) == {"payroll", "recordkeeper", "mapping"} and storage.exists(pack["evidence_pack_zip_path"])
    row = catalogue.find_run(spark, str(tmp_path / "runs"), pack["run_id"]).first()
    assert (row["status"], row["payroll_filename"], row["plan_name"]) == ("completed", "p.csv", "P") and row["manifest_json"]
    with pytest.raises(Exception, match="no employee id"):
        Engine(spark, Config(catalogue=str(tmp_path / "runs"))).run(sides[0].select("is_hce"), sides[1])
    assert sorted(x["status"] for x in catalogue.runs(spark, str(tmp_path / "runs")).collect()) == ["completed", "failed"]


def test_latest_manifest(tmp_path):
    assert integrity.latest_manifest(str(tmp_path / "none")) is None and integrity.latest_manifest(str(tmp_path)) is None
    for name in ("manifest_20250102.json", "manifest_20250101.json", "z.txt"):
        (tmp_path / name).write_text("{}")
    assert integrity.latest_manifest(str(tmp_path)) == storage.qualified(str(tmp_path / "manifest_20250102.json"))


def test_gate_and_safe_run(spark, sides):
    mapping = {"payroll": {"id": {"canonical": "employee_id", "examples": ["nope"]}}}
    assert "no header" in safe_run(Engine(spark), *sides, mapping=mapping)["error"]


def test_files(spark, tmp_path):
    assert files.read_if_there(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "m.yaml").write_text("payroll:\n  id: {canonical: employee_id, examples: [x]}\n")
    assert files.read_mapping(str(tmp_path / "m.yaml"))["payroll"]["id"]["canonical"] == "employee_id"
    (tmp_path / "p.csv").write_text(PAYROLL)
    assert files.read_headers(spark, str(tmp_path / "p.csv"))[0] == "Emp ID"
    (tmp_path / "m.csv").write_text("batch_id,payroll_file,rk_file\nb1,a.csv,b.csv\nb2,a.csv,b.csv\n")  # files shared by batches
    (tmp_path / "a.csv").write_text("employee_id,pay_date,payroll_pretax,payroll_roth,loan_pmt\n1,2025-01-03,5,1,0\n")
    (tmp_path / "b.csv").write_text("employee_id,deposit_date,ee_pretax,ee_roth,loan_contr\n1,2025-01-04,5,1,0\n")
    payroll, rk = files.read_batches(spark, str(tmp_path / "m.csv"), str(tmp_path))
    assert sorted(r["batch_id"] for r in payroll.collect()) == ["b1", "b2"] and rk.count() == 2
    assert files.split_blocks("a.csv\n```csv\nx,y\n1,2\n```\nb.csv\n```\nz\n```\n") == {"a.csv": "x,y\n1,2", "b.csv": "z"}
    assert files.split_blocks("```\n# a.csv\nx\n1\n# b.csv\ny\n```") == {"a.csv": "x\n1", "b.csv": "y"}
    with pytest.raises(KeyError):
        files.strict(payroll, {"employee_id": "missing"})
    assert files.strict(payroll, {"id": "employee_id"}).columns == ["id"]


def test_dates_of_birth_under_other_headers(spark):
    df = spark.createDataFrame([("1", "2025-01-03", "5", "1960-05-01")], "employee_id string, pay_date string, `EE Deferral $` string, `Date of Birth` string")
    rows, *_ = files.prepared(df, "payroll")
    assert str(rows.first()["dob"]) == "1960-05-01"


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b int")
    assert open(sinks.write_csv(empty, str(tmp_path / "e.csv"), single=True)).read().strip() == "a,b"
    odd = spark.createDataFrame([(' say "hi", ', "a\nb", None), (None, '"', "\\")], "x string, y string, z string")
    path = sinks.write_csv(odd, str(tmp_path / "odd.csv"))
    assert sorted(map(str, files.read_csv(spark, path).collect())) == sorted(map(str, odd.collect()))


def test_catalogue_keeps_a_row_per_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert catalogue.runs(spark, path).count() == 0
    for i in range(3):
        catalogue.record_run(path, id=f"r{i}", status="running", plan_name="P", payroll_filename="p.csv")
    catalogue.record_run(path, id="r1", status="completed", summary_json="{}")
    row = catalogue.find_run(spark, path, "r1").collect()
    assert [(r["status"], r["plan_name"], r["summary_json"]) for r in row] == [("completed", "P", "{}")] and row[0]["created_at"] < row[0]["updated_at"]
    assert catalogue.runs(spark, path).count() == 3
    plan = catalogue.find_run(spark, path, "r1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    for _ in range(2):  # the second compaction removes what the first has merged
        catalogue.compact(spark, path)
        catalogue.record_run(path, id="r2", status="failed", error_message="x")
        assert {r["id"]: r["status"] for r in catalogue.runs(spark, path).collect()} == {"r0": "running", "r1": "completed", "r2": "failed"}
    assert catalogue.find_run(spark, path, "none").count() == 0
    with pytest.raises(ValueError, match="colour"):
        catalogue.record_run(path, id="r", colour="red")


def test_runs_are_recorded_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "runs")
    spark.range(1).count()
    with ThreadPoolExecutor(4, initializer=lambda: spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)) as pool:
        list(pool.map(lambda k: catalogue.record_run(path, id=f"r{k % 6}", status=f"s{k // 6}", updated_at=datetime(2025, 1, 1 + k // 6)), range(24)))
    assert sorted((r["id"], r["status"]) for r in catalogue.runs(spark, path).collect()) == [(f"r{k}", "s3") for k in range(6)]


P_KINDS = (
    "Emp ID,Check Date,EE Deferral $,EE Roth $,Loan Repay $\n{0},2025-01-03,100,0,50\n9,2025-01-03,5,5,0\n",
    "employee_id,pay_date,payroll_pretax,payroll_roth,loan_pmt\n{0},2025-01-03,100,0,50\n9,2025-01-03,10,0,0\n",
)
R_KINDS = (
    "Part_ID,Post_Date,EE_PreTax,EE_Roth,Loan_Contr\n{0},2025-01-06,100,0,45\n9,2025-01-06,10,0,0\n",
    "Participant ID,Transaction Date,Pretax Contribution,Roth Contribution,Loan Contribution\n{0},2025-01-20,100,0,50\n9,2025-01-06,9,0,0\n",
)


def write_batches(folder, n):
    out = []
    for name, kinds in (("p", P_KINDS), ("r", R_KINDS)):
        out.append([])
        for k in range(n):
            path = folder / f"{name}{k:03}.csv"
            path.write_text(kinds[k % 2].format(k))
            out[-1].append(str(path))
    return out


def test_batches_from_files(spark, tmp_path):
    payroll, rk = write_batches(tmp_path, 4)
    got = {r["batch_id"]: r for r in run_batches(spark, payroll, rk, "Demo").collect()}
    first, second = got["batch-1"].asDict(), got["batch-2"].asDict()
    assert len(first) == 14 and {k: first[k] for k in ("run_no", "plan_name", "payroll_file", "rk_file", "payroll_vendor", "rk_vendor", "evidence_pack")} == {
        "run_no": 1, "plan_name": "Demo #1", "payroll_file": "p000.csv", "rk_file": "r000.csv", "payroll_vendor": "ADP", "rk_vendor": "VENDOR_RK_1", "evidence_pack": "N/A"}
    assert (float(first["deferrals_payroll"]), first["deferral_mismatches"], first["loan_mismatches"], first["late_deferrals"], first["risk"]) == (110.0, 0, 1, 0, "Low")
    assert (second["payroll_vendor"], second["rk_vendor"], second["deferral_mismatches"], second["loan_mismatches"], second["late_deferrals"]) == ("Unknown", "Vanguard", 1, 0, 1)
    with pytest.raises(ValueError, match="4 and 3"):
        run_batches(spark, payroll, rk[:3])


def test_batches_are_one_scan_a_kind_of_header(spark, tmp_path):
    """Plan and jobs don't grow with the files."""
    sizes, jobs = [], []
    group = 0
    for n in (4, 60):
        folder = tmp_path / str(n)
        folder.mkdir()
        payroll, rk = write_batches(folder, n)
        (folder / "m.csv").write_text("batch_id,payroll_file,rk_file\n" + "".join(f"b{k},p{k:03}.csv,r{k:03}.csv\n" for k in range(n)))
        group += 1
        spark.sparkContext.setJobGroup(f"batches{group}", "")
        p, r = files.read_batches(spark, str(folder / "m.csv"), str(folder))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batches{group}")))
        spark.sparkContext.setJobGroup("rest", "")
        sizes.append(p._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        assert sorted(x["batch_id"] for x in p.select("batch_id").distinct().collect()) == sorted(f"b{k}" for k in range(n)) and r.count() == 2 * n
    assert sizes[0] == sizes[1] and jobs[1] <= jobs[0] + 4  # more files may be listed by jobs
