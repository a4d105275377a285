"""Writers: CSV, JSON reports, HAR archives, event lines, bundles."""
