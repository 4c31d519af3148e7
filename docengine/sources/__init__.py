"""docengine.sources"""
