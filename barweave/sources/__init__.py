from barweave.sources.readers import load_summaries, read_news, read_prices, unpivot_panel
from barweave.sources.writers import manifest, minmax_cache, write_by_entity, write_summaries

__all__ = ["load_summaries", "manifest", "minmax_cache", "read_news", "read_prices", "unpivot_panel",
           "write_by_entity", "write_summaries"]
