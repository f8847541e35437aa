"""Where results go: rendered reports, committed snapshots, and what a write tells about itself."""
