"""Writers for timelines, audit documents, catalog rows, manifests and exports."""
