"""File sources on inline fixtures written to a fresh temp folder."""

import json
import os
import tempfile

from skillgrid.sources import files as FS


def test_csv_folder_union_encoding_and_unnamed(spark):
    d = tempfile.mkdtemp(prefix="sg-csv-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as f:
        f.write('Unnamed: 0,ID,Name\n0,1,"Ca, fé"\n1,2,Plain\n')
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("id,name,extra\n3,Français,x\n".encode("latin-1"))
    enc = {os.path.basename(r.file): r.encoding for r in FS.detect_encodings(spark, d).collect()}
    assert enc == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1"}
    rows = sorted(FS.read_csv_folder(spark, d).collect(), key=lambda r: r.ID)
    assert [(r.ID, r.Name, r.extra) for r in rows] == [(1, "Ca, fé", None), (2, "Plain", None), (3, "Français", "x")]


def test_json_variant_load_skips_bad_files(spark):
    d = tempfile.mkdtemp(prefix="sg-json-")
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump([{"URL": "u1", "Course Name": "c1"}, {"URL": "u2"}], f)
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('[{"URL": "broken"')
    with open(os.path.join(d, "c.json"), "w") as f:
        json.dump({"URL": "u3", "Course Name": "c3", "Rating": "4.5"}, f)
    out = FS.project_landing(FS.read_json_variant(spark, d))
    got = sorted((r.URL, r["Course Name"], r.Rating) for r in out.collect())
    assert got == [("u1", "c1", None), ("u2", None, None), ("u3", "c3", "4.5")]
    assert out.columns == list(FS.LANDING_COLUMNS)
