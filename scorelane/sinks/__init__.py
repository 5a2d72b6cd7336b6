"""Writers for results, prediction maps, catalogues, exports and revisions."""
