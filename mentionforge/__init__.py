"""Entity linking and corpus work as functions from DataFrame to DataFrame."""
