"""DataFrame operators over grids, series, tracks and scores."""
