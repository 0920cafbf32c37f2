"""Named SQL reports and job bundles."""
