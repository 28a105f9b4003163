import pytest

from basewright.sources import fastq


def test_lists_over_the_bound_raise(spark, tmp_path, monkeypatch):
    (tmp_path / "codes").write_text("AC\ta\nGT\tb\nTT\tc\n")
    (tmp_path / "adapters.fa").write_text(">1\nAC\n>2\nGT\n>3\nTT\n")
    monkeypatch.setattr(fastq, "MOST_LISTED", 3, raising=False)
    assert fastq.read_barcodes(spark, str(tmp_path / "codes")) == [("AC", "a"), ("GT", "b"), ("TT", "c")]
    assert fastq.read_adapters(spark, str(tmp_path / "adapters.fa")) == ["AC", "GT", "TT"]
    monkeypatch.setattr(fastq, "MOST_LISTED", 2, raising=False)
    for read, name in ((fastq.read_barcodes, "codes"), (fastq.read_adapters, "adapters.fa")):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / name))
