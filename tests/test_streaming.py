"""The streaming loader gives what the batch loader gives."""

from conftest import rows

from quadloom.sources import ntriples, quads
from quadloom.streaming import loader


def test_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.nq").write_text(f"<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:n> \"{i}\"^^<http://www.w3.org/2001/XMLSchema#int> <urn:g> .\nbroken\n")
        loader.append(loader.stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    loader.compact(spark, str(tmp_path / "store"), str(tmp_path / "all"))
    got = quads.read(spark, str(tmp_path / "all"))
    assert rows(got.quads()) == rows(ntriples.load(spark, str(tmp_path / "in"))[0].distinct())
    assert sorted(r.o_num for r in got.df.where("o_num IS NOT NULL").collect()) == [0.0, 1.0]
