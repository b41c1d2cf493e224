"""Reading sources from files and rendering reports and bundles."""
