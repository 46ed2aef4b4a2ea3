from tessera.config import Config, load


def test_later_files_lie_on_top(tmp_path):
    (tmp_path / "a.toml").write_text("[recall]\nrrf_k = 60\npool = 40\n[nothing]\nx = 1\n")
    (tmp_path / "b.toml").write_text("[recall]\npool = 80\nunknown = 1\n[lifecycle]\ngap_max_best = 1\n")
    c = load(tmp_path / "a.toml", tmp_path / "missing.toml", tmp_path / "b.toml")
    assert (c.recall.rrf_k, c.recall.pool, c.recall.min_similarity, c.lifecycle.gap_max_best) == (60, 80, 0.35, 1.0)
    assert load() == Config()
