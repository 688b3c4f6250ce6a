"""Counts, failures and quoted line breaks of the CSV logs."""

from wardlight.sources import cert_logs


def _write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_counts_failures_and_line_breaks(spark, tmp_path):
    _write(tmp_path, "Logon.CSV", ["ID,Date,User,PC,Activity", "1,01/02/2010 07:30:00,u1,p1,Logon", "2,never,u1,p1,Logon",
                                   ",01/02/2010 07:30:00,u1,p1,Logon", "4,01/02/2010 07:31:00,u2,p1,Logon,extra,fields", "5"])
    _write(tmp_path, "file.csv", ["id,date,user,pc,filename,content", '7,01/02/2010 08:00:00,u1,p1,a.txt,"two', 'lines, ""quoted"""',
                                  "8,01/02/2010 08:01:00,u1,p1,b.txt,one"])
    scan = cert_logs.scan_logs(spark, str(tmp_path))
    counts = {r.file: (r.read, r.converted, r.failed, r.note) for r in scan.counts().collect()}
    assert counts["logon.csv"][:3] == (5, 2, 3)
    assert counts["file.csv"][:3] == (2, 2, 0) and "removable" in counts["file.csv"][3]
    assert counts["http.csv"] == (0, 0, 0, "not found")
    failed = sorted((r.error, r.record) for r in scan.failures().collect())
    assert [e for e, _ in failed] == ["no id", "unreadable date", "unreadable date"]
    assert any('"id":"2"' in record for _, record in failed) and any(record == "5" for _, record in failed)
    assert sorted(r.event_id for r in scan.events().collect()) == ["CERT-file-7", "CERT-file-8", "CERT-logon-1", "CERT-logon-4"]


def test_a_folder_without_logs(spark, tmp_path):
    scan = cert_logs.scan_logs(spark, str(tmp_path))
    assert scan.events().count() == 0 and scan.failures().count() == 0
    assert {r.note for r in scan.counts().collect()} == {"not found"} and scan.counts().count() == 5


def test_row_cap_takes_the_first_rows(spark, tmp_path):
    _write(tmp_path, "device.csv", ["id,date,user,pc,activity", *(f"{i},01/02/2010 07:30:00,u,p,Connect" for i in range(500))])
    events = cert_logs.cert_events(spark, str(tmp_path), row_cap=7)
    assert sorted(r.event_id for r in events.collect()) == sorted(f"CERT-device-{i}" for i in range(7))
