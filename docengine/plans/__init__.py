"""docengine.plans"""
